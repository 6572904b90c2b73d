"""Operations: costs, durations, event feeds, deliveries, idempotency, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RETENTION_DAYS = 90
# Seconds of the first retry, of the longest wait, and how long a delivery is tried.
FIRST_RETRY, LONGEST_RETRY, RETRY_WINDOW = 30, 3600, 24 * 3600


def costs(calls: DataFrame, keys: list[str], cost: str = "cost", currency: str = "currency") -> DataFrame:
    """Sums of cost in exact decimals; a call without cost makes its group incomplete."""
    return calls.groupBy(*keys).agg(
        F.sum(F.coalesce(F.col(cost).cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))).alias("cost"),
        F.max(F.when(F.col(cost).isNull(), 1).otherwise(0)).cast("boolean").alias("incomplete"),
        F.max(currency).alias("currency"),
        F.count("*").alias("calls"),
    )


def duration(start: str, end: str) -> Column:
    """Seconds between two times, 0 where the end lies before the start."""
    return F.greatest((F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6, F.lit(0.0))


def status_pivot(df: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.count(F.when(F.col(status) == v, 1)).alias(v.lower()) for v in values), F.count("*").alias("total"))


def feed(events: DataFrame, now: Column, *, after: int = 0, kind: str | None = None, limit: int = 100) -> DataFrame:
    """The next events behind a cursor, not older than the retention."""
    rows = events.filter((F.col("event_id") > after) & (F.col("ts") >= now - F.expr(f"interval {RETENTION_DAYS} days")))
    rows = rows if kind is None else rows.filter(F.col("event_type") == kind)
    return rows.orderBy("event_id").limit(limit)


def expired(seconds: Column, now: Column) -> Column:
    """Whether a cursor of that epoch second lies before the retention."""
    return seconds < F.unix_timestamp(now) - RETENTION_DAYS * 86400


def coalesced(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first event of each key."""
    return events.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__n = 1").drop("__n")


def fan_out(events: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Deliveries: active endpoints that asked for an event's type, and its outcome if they name one."""
    e = endpoints.filter("active").select("endpoint", F.col("event_type"), F.col("outcome").alias("__outcome"))
    return events.join(e, "event_type").filter(F.col("__outcome").isNull() | (F.col("__outcome") == F.col("outcome"))).drop("__outcome")


def due(deliveries: DataFrame, endpoints: DataFrame, now: Column) -> DataFrame:
    """Deliveries to take now: pending and due, or delivering with the lease over, of active endpoints."""
    ready = ((F.col("state") == "pending") & (F.col("next_at") <= now)) | ((F.col("state") == "delivering") & (F.col("lease_until") < now))
    return deliveries.filter(ready).join(endpoints.filter("active").select("endpoint"), "endpoint", "left_semi")


def backoff(attempt: Column, key: Column, retry_after: Column | None = None) -> Column:
    """Seconds to wait after a failed attempt: doubling from 30 to an hour at most, a fifth more or less by a hash of the key, the endpoint's own wish as floor."""
    base = F.least(FIRST_RETRY * F.pow(F.lit(2.0), attempt - 1), F.lit(float(LONGEST_RETRY)))
    spread = (F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(4001)) / 10000.0) - 0.2
    wait = base * (1 + spread)
    return wait if retry_after is None else F.greatest(wait, F.coalesce(retry_after.cast("double"), F.lit(0.0)))


def outcome(code: Column, age_s: Column) -> Column:
    """What a response means: delivered, failed for good, or another try within a day."""
    final = code.between(400, 499) & ~code.isin(408, 429)
    return F.when(code.between(200, 299), "delivered").when(final | (age_s > RETRY_WINDOW), "failed").otherwise("retry")


def idempotent(requests: DataFrame, key: str, body: str, order: str) -> DataFrame:
    """`requests` with `result`: the first of a key runs, an equal body repeats it, another one conflicts."""
    first = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = requests.withColumn("__h", F.sha2(F.col(body), 256)).withColumn("__f", F.first("__h").over(first)).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return hashed.withColumn("result", F.when(F.col("__n") == 1, "run").when(F.col("__h") == F.col("__f"), "repeat").otherwise("conflict")).drop("__h", "__f", "__n")


def by_project(rows: DataFrame, projects: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """Counts by flag for every project, zeros included."""
    found = rows.groupBy(key).agg(*(F.count(F.when(v, 1)).alias(k) for k, v in flags.items()))
    return projects.join(found, key, "left").fillna(0, list(flags))


def retained(events: DataFrame, created: str, now: Column, days: int = 90) -> DataFrame:
    """Events within the time they are kept; those before it are purged."""
    return events.filter(F.col(created) >= now - F.make_dt_interval(F.lit(days)))


def purge_counts(events: DataFrame, kind: str, created: str, now: Column, days: int = 90) -> DataFrame:
    """(kind, kept, purged) of events by kind, in one pass."""
    old = F.coalesce(F.col(created) < now - F.make_dt_interval(F.lit(days)), F.lit(False))
    return events.groupBy(kind).agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("purged"))
