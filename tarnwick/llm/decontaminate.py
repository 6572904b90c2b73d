"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `n` consecutive words of every benchmark item (an item
of fewer words is one window of its own length). For each pattern length a table of
shifts, keyed by a block of two words, says how far the search may jump; only a block
that ends some pattern stops it. A bucket chosen by that suffix block and by the first
word then names the few patterns that are compared word by word.

The benchmark is cut into shards of at most `SHARD_WINDOWS` windows, and each shard is
one broadcast table of bounded size, built one after another. Documents pass through one narrow
step; where there are several shards it gathers texts of `BUFFER` bytes and takes the shards in turn, so
a task holds one table at a time. Nothing is shuffled.

Defined cases: a null or empty text has no words and no hits; items without words and
items with a null id take no part; repeated items count once; repeated or null document
ids stay rows of their own; other columns are ignored or carried through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.batches import alnum_words, map_batches, texts
from tarnwick.session import materialise, table

#: The most windows in one broadcast table.
SHARD_WINDOWS = 200_000
#: Bytes of text that a task holds while it takes several shards in turn.
BUFFER = 1 << 25
#: Words that start windows in one piece of an item.
PIECE = 2_000


class Search:
    """Shift and bucket tables for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]) -> None:
        self.m, self.b = length, min(2, length)
        self.jump = length - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[bytes, list[tuple[list[bytes], set[str]]]]] = {}
        for words, items in patterns.items():
            for end in range(self.b, length + 1):
                block = words[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.jump), length - end)
            self.bucket.setdefault(words[-self.b :], {}).setdefault(words[0], []).append((list(words), items))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of each occurrence of a pattern."""
        m, b, jump, shift = self.m, self.b, self.jump, self.shift.get
        end, n = m, len(words)
        while end <= n:
            step = shift(tuple(words[end - b : end]), jump)
            if step:
                end += step
                continue
            start = end - m
            for pattern, items in self.bucket[tuple(words[end - b : end])].get(words[start], ()):
                if words[start:end] == pattern:
                    yield start, items
            end += 1


def searches(pieces: list[tuple[str, list[bytes]]], n: int) -> list[Search]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, words in pieces:
        size = min(n, len(words))
        for i in range(len(words) - size + 1):
            by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
    return [Search(size, patterns) for size, patterns in sorted(by_length.items())]


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """Items as pieces of at most PIECE windows, neighbours overlapping by n - 1 words."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
            words = alnum_words(text)
            if item is None or not words:
                continue
            for start in range(0, max(1, len(words) - n + 1), PIECE):
                piece = words[start : start + PIECE + n - 1]
                rows.append((item, start, len(piece), b" ".join(piece).decode(errors="replace")))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["item", "start", "size", "words"])

    return map_batches(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")), cut, "item string, start int, size int, words string")


def pattern_tables(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = 10) -> list[Broadcast]:
    """One broadcast list of searches for each shard of the benchmark."""
    spark = benchmark.sparkSession
    pieces = _pieces(benchmark, item_col, text_col, n).dropDuplicates()
    total = pieces.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total * 2 // SHARD_WINDOWS))
    shard = lambda k: F.pmod(F.xxhash64("item", "start"), F.lit(k))
    while shards > 1 and (pieces.groupBy(shard(shards)).agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0) > SHARD_WINDOWS:
        shards *= 2
    pieces = materialise(pieces, "pieces") if shards > 1 else pieces
    return [
        spark.sparkContext.broadcast(searches([(r.item, r.words.encode().split()) for r in pieces.filter(shard(shards) == k).collect()], n))
        for k in range(shards)
    ]


FOUND = T.StructType([T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _find(words: list[bytes], tables: list[Search], starts: list[int], ends: list[int], items: set[str]) -> None:
    """Adds what `tables` find; starts and ends get one interval for each run of overlapping occurrences."""
    for search in tables:
        for start, found in search.occurrences(words):
            items |= found
            if ends and starts[-1] <= start <= ends[-1]:
                ends[-1] = max(ends[-1], start + search.m)
            else:
                starts.append(start)
                ends.append(start + search.m)


def _covered(starts: list[int], ends: list[int]) -> int:
    covered = last = 0
    for start, end in sorted(zip(starts, ends, strict=True)):
        covered += max(0, end - max(start, last))
        last = max(last, end)
    return covered


def find(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10, into: str = "contamination", keep_text: bool = True) -> DataFrame:
    """`docs` with a struct column `into`: n_words, n_hit, word intervals [starts, ends) and the sorted item ids.

    All other columns pass through; a column that is already called `into` is replaced.
    Without `keep_text` the texts end in the last search instead of going back to the JVM.
    """
    docs = docs.drop(into) if into in docs.columns else docs
    tables = pattern_tables(benchmark, item_col, item_text, n)
    field = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
    spark_field = "struct<n_words:bigint,n_hit:bigint,starts:array<int>,ends:array<int>,items:array<string>>"
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batches in _gathered(it, text_col, BUFFER if len(tables) > 1 else 0):
            found = [([], [], set(), [0]) for batch in batches for _ in range(batch.num_rows)]
            for shared in tables:
                search, at = shared.value, iter(found)
                for batch in batches:
                    for text in texts(batch, text_col):
                        words = alnum_words(text)
                        starts, ends, items, size = next(at)
                        size[0] = len(words)
                        _find(words, search, starts, ends, items)
                if len(tables) > 1:  # the next table takes the place of this one
                    search = vars(shared).pop("_value", None)
            rows = [{"n_words": size[0], "n_hit": _covered(starts, ends), "starts": starts, "ends": ends, "items": sorted(items)} for starts, ends, items, size in found]
            for batch in batches:
                own, rows = rows[: batch.num_rows], rows[batch.num_rows :]
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own, field)], [*(f.name for f in kept), into])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(into, T._parse_datatype_string(spark_field))]))


def _gathered(it: Iterator[pa.RecordBatch], text_col: str, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches with at least `size` bytes of text."""
    held, have = [], 0
    for batch in it:
        if batch.num_rows:
            held.append(batch)
            have += batch.column(batch.schema.get_field_index(text_col)).nbytes
            if have >= size:
                yield held
                held, have = [], 0
    if held:
        yield held


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs, columns unchanged."""
    mark = "contamination" if "contamination" not in docs.columns else "__contamination"
    return find(docs, benchmark, into=mark, **options).filter(F.col(f"{mark}.n_hit") == 0).drop(mark)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words of every benchmark item, searched in every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"), into="found", keep_text=False)
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6_SQL = f"""
with b as (
  select cast(item_id as varchar) as item, {_SQL_WORDS} as w from benchmark where item_id is not null
), pattern as (
  select distinct item, n, array_to_string(w[i + 1:i + n], ' ') as t
  from (select *, unnest(range(len(w) - n + 1)) as i from (select item, w, least(10, len(w)) as n from b where len(w) > 0))
), d as (
  select row_number() over () as r, doc_id, {_SQL_WORDS} as w from documents
), gram as (
  select r, n, i, array_to_string(w[i + 1:i + n], ' ') as t
  from (select r, w, n, unnest(range(len(w) - n + 1)) as i from d, (select distinct n from pattern) where len(w) >= n)
), hit as (
  select r, i, n, item from gram join pattern using (n, t)
), covered as (
  select r, count(distinct word) as n_hit from (select r, unnest(range(i, i + n)) as word from hit) group by 1
), items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hit) group by 1
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (r) left join items using (r)
"""


def brute_force(docs: list[tuple], items: list[tuple], n: int = 10) -> dict:
    """The same digest by comparing every window with every position; for tests."""
    windows: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = alnum_words((text or "").encode())
        for i in range(max(1, len(words) - n + 1) if words and item is not None else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        words, hit, found = alnum_words((text or "").encode()), set(), set()
        for window, ids in windows.items():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= ids
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out
