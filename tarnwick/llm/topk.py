"""Exact top-k inner products by a three-phase uniform threshold.

The score of a vector is the sum of `LISTS` parts, one list of partial scores for each slice
of the dimensions. Entries of a list count only where their part reaches a cutoff divided by
the number of lists: if no part does, the sum can't reach the cutoff.

1. Every task reads its lists down to its own running cutoff (the k-th best score it has
   completed so far), completes the entries it met, and reports a local score list: the k best
   scores of each query.
2. The k-th best score over all local lists is a safe cutoff, since k vectors reach it. It is
   broadcast, and every task collects the entries of which a part reaches cutoff / LISTS.
3. Only the collected entries get their other parts and so their exact score, in integers;
   those that reach the cutoff, at most k of each task, are merged.

Fewer lists prune better: parts of a vector vary like the square root of their dimensions, but
their share of the cutoff falls with the dimensions themselves. Two lists collect a fiftieth of
all pairs where four collect a fifth.

Queries go in blocks of `BLOCK` rows, each a broadcast of bounded size, against all candidates
where they lie: vectors are never shuffled and no pair leaves a task unless it passed the
cutoff. A task works on `GROUP` queries and `CHUNK` candidates at a time.

Defined cases: a null id, a null vector and one with a null or non-finite component take no
part; shorter vectors count as padded with zeros; a repeated id is a candidate per row and a
query once (its smallest vector); rows of the query's own id are no candidates for it; scores
beyond 64 bits are held at the limits of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.session import materialise, table

LISTS = 2
BLOCK = 32_768
GROUP = 1_024
CHUNK = 1_024
_LONG = 2**63 - 1


def vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); rows that take no part are left out."""
    whole = f"forall({vector_col}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(whole).select(
        F.col(id_col).cast("long").alias("vec_id"), F.expr(f"transform({vector_col}, x -> cast(floor({scale}D * cast(x as double)) as bigint))").alias("v")
    )


def _matrix(column: pa.ListArray, dims: int, kind: type) -> np.ndarray:
    """Vectors as rows, from the flat child array of the column."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    if (sizes == dims).all():
        return flat.reshape(-1, dims).astype(kind)
    out = np.zeros((len(column), dims), kind)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Block:
    """Queries of one pass: their ids, and their vectors cut into the slices of the lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.dims, self.kind = ids, rows.shape[1], rows.dtype.type
        self.slices = np.array_split(np.arange(self.dims), min(LISTS, max(1, self.dims)))
        self.rows = [np.ascontiguousarray(rows[:, s]) for s in self.slices]
        self.lowest = -(2**200) if rows.dtype == object else self.kind(-np.inf)

    def lists(self, it: Iterator[pa.RecordBatch]) -> Iterator[tuple[slice, np.ndarray, list[np.ndarray]]]:
        """(queries, candidate ids, parts by list) for groups of queries and chunks of candidates; own rows have the lowest parts."""
        for batch in it:
            for i in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(i, CHUNK)
                at, c = piece.column(0).to_numpy(zero_copy_only=False), _matrix(piece.column(1), self.dims, self.kind)
                c = [np.ascontiguousarray(c[:, s].T) for s in self.slices]
                where = np.searchsorted(self.ids, at)
                own = np.flatnonzero(self.ids[np.minimum(where, len(self.ids) - 1)] == at)
                for g in range(0, len(self.ids), GROUP):
                    parts = [q[g : g + GROUP] @ x for q, x in zip(self.rows, c, strict=True)]
                    mine = own[(where[own] >= g) & (where[own] < g + GROUP)]
                    for part in parts:
                        part[where[mine] - g, mine] = self.lowest
                    yield slice(g, g + len(parts[0])), at, parts


def _read(parts: list[np.ndarray], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the entries of which a part reaches its share of the cutoff: no other is completed."""
    least = (cutoff / len(parts))[:, None]
    met = parts[0] >= least
    for part in parts[1:]:
        met |= part >= least
    flat = np.flatnonzero(met)
    q, c = np.divmod(flat, met.shape[1])
    return q, c, sum(part.ravel()[flat] for part in parts)


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best entries, ties to the smaller id, in order of query and rank."""
    order = np.lexsort((ids, -score, q))
    q = q[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


class _Kept:
    """The best entries met so far of each query."""

    def __init__(self, n: int, k: int, kind: type) -> None:
        self.k, self.n, self.size = k, n, 0
        self.held: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64))]

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((q, score, ids))
        self.size += len(q)

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        best = _best(q, score, ids, self.k)
        self.held, self.size = [(q[best], score[best], ids[best])], 0
        return self.held[0]


def _local_lists(k: int, shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        n = len(block.ids)
        cutoff = np.full(n, block.lowest, block.kind)
        kept = _Kept(n, k, block.kind)
        for queries, at, parts in block.lists(it):
            known = cutoff[queries]
            fresh = known == block.lowest
            if fresh.any():  # nothing completed yet: the head of each list, its k best entries
                head = [np.argpartition(-part, min(k, part.shape[1] - 1), axis=1)[:, :k] for part in parts]
                q, c = np.repeat(np.arange(len(known)), sum(h.shape[1] for h in head)), np.concatenate(head, axis=1).ravel()
                pair = np.unique(q * len(at) + c)
                q, c = np.divmod(pair, len(at))
                score = sum(part[q, c] for part in parts)
            else:
                q, c, score = _read(parts, known)
            good = (score >= known[q]) & (score > block.lowest)
            kept.add(q[good] + queries.start, score[good], at[c[good]])
            if fresh.any() or kept.size > 4 * k * GROUP:
                q, score, _ = kept.shrink()
                kth = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
                cutoff[q[kth]] = score[kth]
        q, score, _ = kept.shrink()
        if len(q):
            ends = np.searchsorted(q, np.arange(n + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(score.astype(float)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), lists], ["q", "scores"])

    return run


def _entries(k: int, shared, cutoffs):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cutoff = shared.value, cutoffs.value
        kept = _Kept(len(block.ids), k, block.kind)
        for queries, at, parts in block.lists(it):
            q, c, score = _read(parts, cutoff[queries])
            good = np.asarray((score >= cutoff[queries][q]) & (score > block.lowest), bool)
            kept.add(q[good] + queries.start, score[good], at[c[good]])
            if kept.size > 4 * k * GROUP:
                kept.shrink()
        q, score, ids = kept.shrink()
        if len(q):
            score = np.array([max(-_LONG, min(_LONG, int(s))) for s in score.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates; both sides as `vectors` returns them."""
    spark = candidates.sparkSession
    facts = candidates.unionByName(queries).agg(F.max(F.size("v")), F.max(F.expr("array_max(transform(v, x -> abs(cast(x as double))))"))).first()
    dims, largest = facts[0] or 0, facts[1] or 0.0
    # sums of products are exact integers in single precision, in double precision, or as Python's
    reach = largest * largest * max(1, dims)
    kind = np.float32 if reach < 2.0**23 else np.float64 if reach < 2.0**52 else object
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks().sort_by("vec_id")
        if not rows.num_rows:
            continue
        block = Block(rows.column("vec_id").to_numpy(), _matrix(rows.column("v").combine_chunks(), dims, kind))
        shared = spark.sparkContext.broadcast(block)
        lists = candidates.mapInArrow(_local_lists(k, shared), "q int, scores array<double>")
        # lists are merged in two steps, so no group holds the lists of all tasks
        merged = F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("scores")))), 1, k).alias("scores")
        part = lists.groupBy("q", F.pmod(F.spark_partition_id(), F.lit(64)).alias("p")).agg(merged)
        kth = part.groupBy("q").agg(merged).filter(F.size("scores") == k).select("q", F.element_at("scores", k).alias("cutoff")).toArrow()
        cutoff = np.full(rows.num_rows, -np.inf)
        cutoff[kth.column("q").to_numpy()] = kth.column("cutoff").to_numpy() if kind is not object else np.nextafter(kth.column("cutoff").to_numpy(), -np.inf)
        cutoff = cutoff if kind is object else cutoff.astype(kind)
        entries = candidates.mapInArrow(_entries(k, shared, spark.sparkContext.broadcast(cutoff)), "query_id long, vec_id long, score long")
        entries = materialise(entries, "entries") if blocks > 1 else entries
        found = entries if found is None else found.unionByName(entries)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for each whose id is divisible by 20."""
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)


OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c as (
  select vec_id, unnest(v) as x, unnest(range(len(v))) as i from v
), s as (
  select q.vec_id as query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) as score
  from c q join c on q.i = c.i and q.vec_id <> c.vec_id
  where q.vec_id % 20 = 0 group by all
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank", vec_id, score from s
)
select query_id, "rank", vec_id, score from r where "rank" <= 20
"""
