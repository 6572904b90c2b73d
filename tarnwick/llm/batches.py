"""Arrow batches inside tasks: whole texts as UTF-8 bytes, results as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits of the bitmap by which rows are picked, as a power of two; it reaches the driver.
PICKED = 24

#: Bytes that separate words: everything in ASCII but letters and digits; capitals are lowered.
_ALNUM = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return [x or b"" for x in col.to_pylist()]


def plain_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), unchanged."""
    return text.split()


def lower_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered, all other bytes unchanged."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered."""
    return text.translate(_ALNUM).split()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str) -> DataFrame:
    """`fn` on each Arrow batch of `df`; a narrow step, nothing is shuffled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def bitmap(bits: DataFrame, power: int) -> np.ndarray:
    """The 2 ** `power` bits of which the numbers in the column `bit` are set, eight to a byte; they reach the driver."""
    after = bits.select((F.col("bit") + 1).alias("bit"))
    maps = after.groupBy(F.expr("bitmap_bucket_number(bit)").alias("at")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map")).toArrow()
    out = np.zeros((1 << power) // 8, np.uint8)
    for row in maps.to_pylist():
        start = (row["at"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(row["map"], np.uint8)
    return out


def among(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows of `df` whose `col` is in that of `ids`, and a few others: a bitmap decides, so no row of `df` is shuffled."""
    place = F.xxhash64(col).bitwiseAND(F.lit((1 << PICKED) - 1))
    shared = df.sparkSession.sparkContext.broadcast(bitmap(ids.select(place.alias("bit")), PICKED))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bit = batch.column(batch.num_columns - 1).to_numpy()
        keep = (shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        return batch.select(batch.schema.names[:-1]).filter(pa.array(keep.astype(bool)))

    return map_batches(df.withColumn("__bit", place), run, df.schema)
