"""Session helpers: table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows that a task sorts or groups at most, about.
ROWS_A_TASK = 500_000
#: Tables that this process wrote to the shared folder.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder, read by Spark alone (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    Where the setting is absent in a local session (as in tests) a fresh local folder is
    made and set, so that checkpoint() and written tables both work; on a cluster its
    absence is an error, since executors don't see the driver's folders.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        kept = sc._jsc.sc().getCheckpointDir()
        path = kept.get() if kept.isDefined() else None
    if not path and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="spark-tarnwick-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, name: str = "t", **options: int) -> DataFrame:
    """Write `df` once as Parquet, with the writer's `options`, in the shared folder and read it back.

    Cuts lineage like a reliable checkpoint, but columnar and compressed; a lost
    executor costs nothing, since the files are in the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnwick-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Within it, what is run takes Arrow batches of some `size` bytes at most; the session's own limit comes back after it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """`df` dealt by `keys` to as many tasks as keep each to some `ROWS_A_TASK` rows, where the session's partitions are fewer.

    `rows` is how many there are, where that is known; a table of files is counted from their footers.
    """
    parts = (df.count() if rows is None else rows) // ROWS_A_TASK + 1
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *keys)


def release(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that `materialise` returned, once everything derived from them is written."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path in _written:
            _written.remove(path)
            delete(df.sparkSession, path)


def scratch() -> frozenset[str]:
    """The tables that stand in the scratch folder now."""
    return frozenset(_written)


def release_since(spark: SparkSession, before: frozenset[str], *keep: DataFrame) -> None:
    """Deletes the tables written after `before` was taken, but for those behind `keep`."""
    kept = {getattr(df, "_scratch", None) for df in keep}
    for path in [p for p in _written if p not in before and p not in kept]:
        _written.remove(path)
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder of any Hadoop file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the tables that `materialise` wrote in this process, when no frame that reads them is needed any more."""
    gone = 0
    while _written:
        gone += int(delete(spark, _written.pop()))
    return gone
