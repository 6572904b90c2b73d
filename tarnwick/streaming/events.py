"""The event log as a stream: coalescing, fan-out, rollups and keyed merges, each restartable from its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators import ingest, operations
from tarnwick.session import delete, shared_dir


def read(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """The table as a stream of files; times without zone count as UTC, so that watermarks hold."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parquet*")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def coalesced(events: DataFrame, keys: list[str], time: str = "ts", late: str = "7 days") -> DataFrame:
    """One event of each key; state is kept for `late` and no longer."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def fan_out(events: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Deliveries of a stream to a static table of endpoints."""
    return operations.fan_out(events, endpoints)


def rollup(events: DataFrame, window: str, keys: list[str], time: str = "ts", late: str = "7 days") -> DataFrame:
    """Counts and sums in tumbling windows of event time."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *keys, "events", "value")


def sessions(events: DataFrame, gap: str, keys: list[str], time: str = "ts", late: str = "7 days") -> DataFrame:
    """Runs of events of a key with no pause as long as `gap`."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "events")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote; files and checkpoint lie in the shared folder.

    A windowed append gives out a window once the watermark passed it; in complete mode every window is given out.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/tarnwick-stream-{uuid.uuid4().hex}"
    if mode == "complete":
        writer = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"))
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
    writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def merge_each(path: str, key: str, overwrite: list[str], keep_if_null: list[str] = (), order: str = "event_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each micro-batch into a table by key, where a row of a smaller `order` than the stored one changes
    nothing, however late it comes. The table is versions side by side, named by batch: a batch that is run again after a
    failure writes its own version anew from the one before, and the one before that is deleted."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last = ingest.latest(batch, [key], [F.desc(order)]).select(key, *overwrite, *keep_if_null, order)
        if n:
            stored = spark.read.parquet(f"{path}/v{n - 1}")
            newer = last.join(stored.select(key, F.col(order).alias("__order")), key, "left").filter(F.col("__order").isNull() | (F.col(order) > F.col("__order"))).drop("__order")
            last = ingest.upsert(stored, newer, key, [*overwrite, order], list(keep_if_null)).drop("action")
        last.write.mode("overwrite").parquet(f"{path}/v{n}")
        if n > 1:
            delete(spark, f"{path}/v{n - 2}")

    return merge
