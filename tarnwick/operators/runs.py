"""Runs and their items: claims, reclaims, final states, histories, slugs, stored checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.session import materialise

LEASE = "5 minutes"


def claim(deliveries: DataFrame, due: DataFrame, key: str, now: Column, worker: str) -> DataFrame:
    """`deliveries` with the due ones taken: delivering, one more attempt, leased to `worker`."""
    d = deliveries.join(due.select(key, F.lit(True).alias("__due")), key, "left")
    take = F.coalesce("__due", F.lit(False))
    return d.withColumns(
        {
            "state": F.when(take, "delivering").otherwise(F.col("state")),
            "attempts": F.col("attempts") + take.cast("int"),
            "lease_until": F.when(take, now + F.expr(f"interval {LEASE}")).otherwise(F.col("lease_until")),
            "owner": F.when(take, worker).otherwise(F.col("owner")),
        }
    ).drop("__due")


def reclaim(items: DataFrame, now: Column, limit: str = "18 minutes") -> DataFrame:
    """Items that run longer than the limit are pending again."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"interval {limit}"))
    return items.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).withColumn("started_at", F.when(~stale, F.col("started_at")))


def final_state(items: DataFrame, run: str, status: str) -> DataFrame:
    """(run, state): running while any item is open, else failed, partial or succeeded."""
    n = lambda *values: F.count(F.when(F.col(status).isin(*values), 1))
    sums = items.groupBy(run).agg(n("pending", "running").alias("open"), n("failed").alias("bad"), n("succeeded").alias("good"))
    state = F.when(F.col("open") > 0, "running").when(F.col("bad") == 0, "succeeded").when(F.col("good") == 0, "failed").otherwise("partial")
    return sums.select(run, state.alias("state"))


def history(direct: DataFrame, pointed: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(article, item, via): items that concern an article, each once, by its strongest tie."""
    tie = lambda df, rank, via: df.select("article", "item", F.struct(F.lit(rank).alias("rank"), F.lit(via).alias("via")).alias("tie"))
    every = tie(direct, 0, "key").unionByName(tie(pointed, 1, "source")).unionByName(tie(mentioned, 2, "json"))
    return every.groupBy("article", "item").agg(F.min("tie")["via"].alias("via"))


def slugs(rows: DataFrame, key: str, label: str, taken: DataFrame | None = None) -> DataFrame:
    """(key, slug): labels as slugs, all different and none in `taken` (slug).

    Rows of one base get it in the order of their keys, first plain and then with the smallest numbers that are free:
    what is taken, or is the plain base of another label, isn't. There is no largest number. Of a base's k-th row and the
    numbers that aren't free, those with fewer than k free ones below come before it; so in one order of both a row's
    place within its base is its number. Rows of an equal key share a number only if they are one row: keys are unique.
    """
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "-"), "^-|-$", "")
    b = rows.select(F.col(key).alias("key"), F.when(F.coalesce(base, F.lit("")) == "", "item").otherwise(base).alias("base"))
    plain = taken.select("slug") if taken is not None else rows.sparkSession.createDataFrame([], "slug string")
    numbered = plain.unionByName(b.select(F.col("base").alias("slug")).distinct()).filter(F.col("slug").rlike(r"^.+-[1-9]\d{0,17}$"))
    number = F.regexp_extract("slug", r"-(\d+)$", 1).try_cast("long")
    used = numbered.select(F.regexp_replace("slug", r"-\d+$", "").alias("base"), number.alias("n")).filter(number >= 2)
    used = used.unionByName(plain.select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("n"))).distinct()
    used = placed(used.join(b.select("base").distinct(), "base", "left_semi"), "base", [F.col("n")]).withColumn("free", F.col("n") - F.col("place"))
    b = placed(b, "base", [F.col("key")])
    none = F.lit(None).cast(b.schema["key"].dataType)
    # a number that isn't free has n - place free ones below it, and stands before the row that would be the next
    both = b.select("base", F.col("place").alias("at"), F.lit(0).alias("kind"), "key").unionByName(used.select("base", F.col("free").alias("at"), F.lit(1).alias("kind"), none.alias("key")))
    given = placed(both, "base", [F.col("at"), F.col("kind")]).filter("kind = 0")
    return given.select(F.col("key").alias(key), F.when(F.col("place") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("place").cast("string"))).alias("slug"))


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """`rows` with `place`, from 1 within `group` in `order`, whatever the group's size: ordinals less those before the group."""
    all_ = materialise(ordinals(rows, [F.col(group), *order]), "placed")
    first = materialise(all_.groupBy(group).agg(F.min("ordinal").alias("__first")), "first")
    return all_.join(first, group).withColumn("place", F.col("ordinal") - F.col("__first") + 1).drop("ordinal", "__first")


def ordinals(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with `ordinal`, from 1 in total order: ranges are sorted apart, and each begins where those before it end.

    The ranges are written once, so that both passes see the same; `order` should leave no ties.
    """
    ranges = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__part").agg(F.count("*").alias("__size"))
    # a row for each range, not for each of the table's
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    inside = ranges.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return inside.join(F.broadcast(starts), "__part").withColumn("ordinal", F.col("__before") + F.col("__n")).drop("__part", "__before", "__n")


def stored_check(findings: DataFrame, order: list[Column], scope: str) -> DataFrame:
    """Findings with their ordinal and the hash of what was checked, for pages that stay as they were."""
    return ordinals(findings, order).withColumn("scope_hash", F.sha2(F.lit(scope), 256)).withColumn("ordinal", F.col("ordinal").cast("int"))


def latest_check(checks: DataFrame, status: str | None = None) -> DataFrame:
    """The newest run of each (scope, check), of those with `status` if one is given; ties go to the larger id."""
    kept = checks if status is None else checks.filter(F.col("status") == status)
    newest = kept.groupBy("scope", "check").agg(F.max(F.struct("created_at", "id", "status")).alias("r"))
    return newest.select("scope", "check", "r.id", "r.status", "r.created_at")


def sample_texts(mentions: DataFrame, key: str, text: str, n: int = 3, length: int = 220) -> DataFrame:
    """(key, samples): up to n different trimmed texts of each key, cut to `length`, in order."""
    trimmed = mentions.select(key, F.substring(F.trim(text), 1, length).alias("t")).filter("t != ''").distinct()
    top = trimmed.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("t"))).filter(F.col("__n") <= n)
    return top.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("t")), " | ").alias("samples"))


def oldest(items: DataFrame, keys: list[str], status: str, created: str, now: Column) -> DataFrame:
    """Seconds that the oldest pending item of each group waits."""
    return items.filter(F.col(status) == "pending").groupBy(*keys).agg((F.unix_timestamp(now) - F.unix_timestamp(F.min(created).cast("timestamp"))).alias("waits_s"))
