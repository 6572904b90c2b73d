"""Writers: consolidated results, partitions replaced in place, bundles with manifest, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_ROWS = 2_000


def consolidated(*branches: DataFrame, key: str, transient: tuple[str, ...] = ()) -> DataFrame:
    """(key, result): the branches' columns merged to one JSON object for each key; later branches win, transient columns go."""
    out, owner = None, {}
    for i, b in enumerate(branches):
        named = b.select(key, *(F.col(c).alias(f"__{i}_{c}") for c in b.columns if c != key))
        owner |= {c: f"__{i}_{c}" for c in b.columns if c != key and c not in transient}
        out = named if out is None else out.join(named, key, "full_outer")
    return out.select(key, F.to_json(F.struct(*(F.col(v).alias(k) for k, v in sorted(owner.items())))).alias("result"))


def replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Writes partitions anew and leaves all others: what a source file gave before is replaced by what it gives now."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def export_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """JSON lines in files of at most SHARD_ROWS rows, and a manifest of rows and digest for each file."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", SHARD_ROWS).json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    # a shuffle of the manifest's rows: without one a single task would read all files
    manifest(spark, path, list(tables)).repartition(1).write.mode("overwrite").json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(table, file, rows, sha256) of a bundle's files; a file is one bounded shard, hashed where it is read."""
    out = None
    for name in names:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{path}/{name}")
        text = F.decode("content", "UTF-8")
        rows = F.length(text) - F.length(F.replace(text, F.lit("\n")))
        one = files.select(F.lit(name).alias("table"), F.element_at(F.split("path", "/"), -1).alias("file"), rows.cast("long").alias("rows"), F.sha2("content", 256).alias("sha256"))
        out = one if out is None else out.unionByName(one)
    return out


def damaged(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Files of a bundle that its manifest doesn't vouch for, and those it names that aren't there."""
    said = spark.read.schema("`table` string, file string, rows long, sha256 string").json(f"{path}/manifest")
    there = manifest(spark, path, names)
    keys = ["table", "file", "rows", "sha256"]
    return there.join(said, keys, "left_anti").select("table", "file").unionByName(said.join(there, keys, "left_anti").select("table", "file")).distinct()


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a log that is never rewritten."""
    df.write.mode("append").parquet(path)
