"""Ranked lexical search over an index of shards, with term-pair bounds in MaxScore.

The index is a table with one row for each shard: at most `SHARD` documents in order of length, with the
postings (document, frequency) of every term. Tasks build it where the texts lie and read it where
it lies; only counts and best scores are shuffled.

Queries come in blocks of a bounded number of terms. For a block, `pair_lists` writes what search needs of each shard:
the impacts (score contributions) of the block's terms, their maxima for each run of `RUN` documents, and for
pairs of a query's terms the intersection list: the runs that hold documents with both terms, each with
the joint maximum impact, the largest sum that a document with both reaches. A document in a run can get from a pair no more
than max(joint maximum, either term's maximum), which is less than the sum of both maxima wherever no document has both at
their best. The bound of a run is the sum over the query's pairs.

Each shard reports the exact scores of the run with the highest bound; the k-th best over all shards is a cutoff
that k documents reach. Search then drops the runs whose bound stays below the cutoff, adds pair by pair in falling order of
bounds, and drops a document as soon as its score so far and the bounds of the pairs to come can't
reach the cutoff. The cutoff rises with the results of the task. All scores are exact 64-bit integers.

Defined cases: a null text and one without terms has no score and doesn't count in N; rows of one doc_id are documents of their
own; null ids rank after all others and come back as null; rows of one item_id are one item with the
terms of all of them; an item without terms, or a table without documents, gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.llm.batches import alnum_words, map_batches, texts
from tarnwick.session import batches_of, materialise, release, table

#: Documents and postings of a shard, and documents of a run.
SHARD, POSTINGS, RUN = 4096, 1 << 20, 16
#: Terms of the queries that are searched in one pass.
BLOCK_TERMS = 1 << 15
#: Texts that are taken out of a batch at a time.
TEXTS = 256
#: Bytes of an Arrow batch of texts or of shards, about.
BATCH = 1 << 24
#: A row is megabytes long: Parquet asks after each whether its row group is full, not after the hundredth, and readers load a small group at once.
LONG_ROWS = {"parquet.block.size": 1 << 24, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
_NO_ID = 2**63 - 1
_INDEX = "ids array<long>, lengths array<long>, terms array<binary>, ends array<int>, docs array<int>, tfs array<int>"


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: a row for each shard with ids and lengths of its documents, terms, and postings up to each term's end."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def shard(place: dict[bytes, int], held: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        held.sort(key=lambda x: x[:2])
        terms = sorted(place)
        rank = np.empty(len(terms), np.int32)
        rank[np.fromiter(map(place.__getitem__, terms), np.int32, len(terms))] = np.arange(len(terms), dtype=np.int32)
        term = rank[np.concatenate([x[2] for x in held])]
        doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(x[2]) for x in held])
        order = np.argsort(term, kind="stable")
        ends = np.cumsum(np.bincount(term, minlength=len(terms)))
        row = {"ids": [x[1] for x in held], "lengths": [x[0] for x in held], "terms": terms, "ends": ends, "docs": doc[order], "tfs": np.concatenate([x[3] for x in held])[order]}
        kinds = {"ids": pa.int64(), "lengths": pa.int64(), "terms": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(kinds.get(k, pa.int32()))) for k, v in row.items()], list(row))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a term is named once for a shard, so a posting that waits takes eight bytes
        place: dict[bytes, int] = {}
        held, size = [], 0
        for batch in it:
            for start in range(0, batch.num_rows, TEXTS):
                few = batch.slice(start, TEXTS)
                for i, text in zip(few.column(0).fill_null(_NO_ID).to_pylist(), texts(few, "text"), strict=True):
                    words = alnum_words(text)
                    if not words:
                        continue
                    counts = Counter(words)
                    own = np.fromiter((place.setdefault(t, len(place)) for t in counts), np.int32, len(counts))
                    held.append((len(words), i, own, np.fromiter(counts.values(), np.int32, len(counts))))
                    size += len(counts)
                    if len(held) == SHARD or size >= POSTINGS:
                        yield shard(place, held)
                        place, held, size = {}, [], 0
        if held:
            yield shard(place, held)

    return docs.mapInArrow(run, _INDEX)


class Queries:
    """A block of queries: ids, and for each the places of its terms among the block's terms, in falling order of weight."""

    def __init__(self, ids: list, of: list[list[bytes]], weights: dict[bytes, int], facts: tuple[int, int]) -> None:
        self.ids, (self.n, self.words) = ids, facts
        self.terms = sorted({t for q in of for t in q})
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.weight = [weights.get(t, 0) for t in self.terms]
        ranked = [sorted((self.place[t] for t in q), key=lambda p: (-self.weight[p], p)) for q in of]
        # neighbours in weight make a pair: bounds that are alike are the loosest together
        self.pairs = [[(q[i], q[i + 1] if i + 1 < len(q) else -1) for i in range(0, len(q), 2)] for q in ranked]
        self.named = sorted({p for q in self.pairs for p in q if p[1] >= 0})


def norms(lengths: np.ndarray, n: int, words: int) -> np.ndarray:
    """The length part m of each document's impacts: 10 + (90 * length * n) div words."""
    if len(lengths) and 90 * n * int(lengths.max()) >= 2**63:
        return np.array([10 + 90 * x * n // words for x in lengths.tolist()], np.int64)
    return 10 + 90 * lengths * n // words


class Shard:
    """A shard as one block of queries sees it: impacts, their maxima by run, and the pairs' intersection lists."""

    def __init__(self, ids: np.ndarray, lists: dict[int, tuple[np.ndarray, np.ndarray]], maxima: dict[int, np.ndarray], joint: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> None:
        self.ids, self.lists, self.maxima, self.joint = ids, lists, maxima, joint
        self.runs = -(-len(ids) // RUN)
        self.tight: dict[tuple[int, int], np.ndarray] = {}

    def bound(self, pair: tuple[int, int]) -> np.ndarray:
        """By run, the most that a document gets from a pair."""
        if pair not in self.tight:
            a, b = (self.maxima.get(t) for t in pair)
            if a is None or b is None:
                out = np.zeros(self.runs, np.int64) if a is None and b is None else b if a is None else a
            else:
                out = np.maximum(a, b)
                runs, most = self.joint[pair]
                out[runs] = np.maximum(out[runs], most)
            self.tight[pair] = out
        return self.tight[pair]

    def score(self, pairs: list[tuple[int, int]], cutoff: int, runs: np.ndarray | None = None, met: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that reach `cutoff`, at least 1, among those of `runs`."""
        bounds = [self.bound(p) for p in pairs]
        order = sorted(range(len(pairs)), key=lambda i: -int(bounds[i].max(initial=0)))
        rest = np.sum(bounds, axis=0) if bounds else np.zeros(self.runs, np.int64)
        live = rest >= cutoff
        if runs is not None:
            live &= np.isin(np.arange(self.runs), runs)
        candidates = np.flatnonzero(np.repeat(live, RUN)[: len(self.ids)])
        of, total = candidates // RUN, np.zeros(len(self.ids), np.int64)
        if met is not None:
            met.append(len(candidates))
        for i in order:
            if not len(candidates):
                break
            for term in pairs[i]:
                found = self.lists.get(term)
                if found is None:
                    continue
                docs, impacts = found
                if len(candidates) * 8 < len(docs):
                    at = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
                    has = docs[at] == candidates
                    total[candidates[has]] += impacts[at[has]]
                else:
                    total[docs] += impacts
            rest = rest - bounds[i]
            keep = total[candidates] + rest[of] >= cutoff
            candidates, of = candidates[keep], of[keep]
        return candidates, total[candidates]


def _impacts(row: dict, queries: Queries) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By the block's terms that a shard holds, (documents, impacts)."""
    m = norms(row["lengths"], queries.n, queries.words)
    at = {t: i for i, t in enumerate(row["terms"])}
    out = {}
    for p, term in enumerate(queries.terms):
        if (i := at.get(term)) is not None:
            own = slice(row["ends"][i - 1] if i else 0, row["ends"][i])
            docs, tf = row["docs"][own], row["tfs"][own].astype(np.int64)
            out[p] = docs, queries.weight[p] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
    return out


def _maxima(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs, largest value in each) of ascending documents."""
    runs = docs // RUN
    first = np.flatnonzero(np.diff(runs, prepend=-1))
    return runs[first], np.maximum.reduceat(values, first) if len(first) else values


def _joint(lists: dict, queries: Queries, size: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By pair, the runs that hold documents with both terms, and the largest sum of both impacts in each."""
    out, full = {}, np.zeros(size, np.int64)
    has, last = np.zeros(size, bool), -1
    for a, b in queries.named:
        if a in lists and b in lists:
            if a != last:  # pairs come in order of their first term
                has[:], last = False, a
                has[lists[a][0]] = True
                full[lists[a][0]] = lists[a][1]
            docs, impacts = lists[b]
            both = has[docs]
            out[a, b] = _maxima(docs[both], impacts[both] + full[docs[both]])
    return out


def _flat(column: pa.Array) -> list:
    """Each row's list, numbers as arrays."""
    return [x.values.to_pylist() if pa.types.is_binary(x.type.value_type) else x.values.to_numpy() for x in column]


_LISTS = "ids array<long>, term array<int>, ends array<int>, docs array<int>, impacts array<long>, a array<int>, b array<int>, pair_ends array<int>, runs array<int>, joint array<long>, heads array<array<long>>"


def pair_lists(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """For each shard the impacts of the block's terms, the pairs' intersection lists, and each query's best scores in its best run."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def one(row: dict) -> list:
        block = shared.value
        lists = _impacts(row, block)
        size = len(row["ids"])
        joint = _joint(lists, block, size)
        shard = Shard(row["ids"], lists, dense(lists, size), joint)
        heads = []
        for pairs in block.pairs:
            whole = np.sum([shard.bound(p) for p in pairs], axis=0) if pairs else np.zeros(shard.runs, np.int64)
            scores = shard.score(pairs, 1, np.array([int(whole.argmax())]))[1] if len(whole) and whole.max() > 0 else np.zeros(0, np.int64)
            shard.tight.clear()
            heads.append(np.sort(scores)[::-1][:k])
        cut = lambda found: np.cumsum([len(x[0]) for x in found.values()], dtype=np.int32)
        flat = lambda found, i, kind: np.concatenate([x[i] for x in found.values()]).astype(kind) if found else np.zeros(0, kind)
        return [
            row["ids"], np.array(list(lists), np.int32), cut(lists), flat(lists, 0, np.int32), flat(lists, 1, np.int64),
            np.array([p[0] for p in joint], np.int32), np.array([p[1] for p in joint], np.int32), cut(joint), flat(joint, 0, np.int32), flat(joint, 1, np.int64), heads,
        ]

    names = [x.split()[0] for x in _LISTS.split(", ")]
    kinds = [pa.list_(pa.int64() if "long" in x else pa.int32()) for x in _LISTS.split(", ")[:-1]] + [pa.list_(pa.list_(pa.int64()))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                found = one({name: _flat(c)[0] for name, c in zip(own.schema.names, own.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(found, kinds, strict=True)], names)

    return index.mapInArrow(run, _LISTS)


def dense(lists: dict, size: int) -> dict[int, np.ndarray]:
    """By term, the largest impact in every run."""
    out = {}
    for p, (docs, impacts) in lists.items():
        out[p] = np.zeros(-(-size // RUN), np.int64)
        runs, most = _maxima(docs, impacts)
        out[p][runs] = most
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def ranked(lists: DataFrame, queries: Queries, cutoffs: np.ndarray, k: int) -> DataFrame:
    """(q, doc_id, score): each task's best of every query that reach the cutoff."""
    shared = lists.sparkSession.sparkContext.broadcast((queries, cutoffs))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, given = shared.value
        cutoff = given.copy()
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(block.pairs)
        for batch in it:
            for ids, term, ends, docs, impacts, a, b, pair_ends, runs, joint in zip(*(_flat(batch.column(i)) for i in range(10)), strict=True):
                cut = lambda x, ends: np.split(x, ends[:-1])
                found = dict(zip(term.tolist(), zip(cut(docs, ends), cut(impacts, ends), strict=True))) if len(term) else {}
                both = dict(zip(zip(a.tolist(), b.tolist(), strict=True), zip(cut(runs, pair_ends), cut(joint, pair_ends), strict=True))) if len(a) else {}
                shard = Shard(ids, found, dense(found, len(ids)), both)
                for q, pairs in enumerate(block.pairs):
                    at, scores = shard.score(pairs, int(cutoff[q]))
                    if len(at):
                        i, s = np.concatenate([kept[q][0], ids[at]]), np.concatenate([kept[q][1], scores])
                        best = _best(i, s, k)
                        kept[q] = i[best], s[best]
                        if len(best) == k:
                            cutoff[q] = max(cutoff[q], s[best[-1]])
                    shard.tight.clear()
        q = np.repeat(np.arange(len(kept), dtype=np.int32), [len(i) for i, _ in kept])
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([i for i, _ in kept])), pa.array(np.concatenate([s for _, s in kept]))], ["q", "doc_id", "score"])

    names = [x.split()[0] for x in _LISTS.split(", ")][:-1]
    return lists.select(*names).mapInArrow(run, "q int, doc_id long, score long")


def item_terms(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct terms of every item."""
    items = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = [sorted(set(alnum_words(t))) for t in texts(batch, "text")]
        row = np.repeat(np.arange(len(of)), [len(x) for x in of])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([t for x in of for t in x], pa.binary())], ["item", "term"])

    return map_batches(items, run, f"item {items.schema['item'].dataType.simpleString()}, term binary").distinct()


def search(index: DataFrame, items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of a written index."""
    spark = index.sparkSession
    facts = index.select(F.expr("size(lengths)").alias("n"), F.expr("aggregate(lengths, 0L, (x, y) -> x + y)").alias("words")).agg(F.sum("n"), F.sum("words")).first()
    asked = materialise(item_terms(items, id_col=id_col, text_col=text_col), "asked")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    parts = []
    for b in range(blocks if facts[0] else 0):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        # document frequencies of the block's terms alone; each shard counts its own
        held = index.select(F.explode(F.expr("transform(terms, (t, i) -> struct(t as term, ends[i] - if(i = 0, 0, ends[i - 1]) as df))")).alias("x")).select("x.*")
        df = held.join(own.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        weights = {t: math.floor(1000 * math.log((2 * facts[0] + 2) / (2 * n + 1))) for t, n in zip(df.column(0).to_pylist(), df.column(1).to_pylist(), strict=True)}
        of = defaultdict(list)
        rows = own.toArrow()
        for item, term in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            if term in weights:
                of[item].append(term)
        if not of:
            continue
        block = Queries(list(of), [sorted(x) for x in of.values()], weights, (facts[0], facts[1]))
        with batches_of(spark, BATCH):
            lists = materialise(pair_lists(index, block, k), "pairs", **LONG_ROWS)
        heads = lists.select(F.posexplode("heads").alias("q", "scores"))
        # in two steps, so no group holds the lists of all shards
        top = F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("scores")))), 1, k).alias("scores")
        best = heads.groupBy("q", F.pmod(F.spark_partition_id(), F.lit(64)).alias("p")).agg(top).groupBy("q").agg(top)
        kth = best.filter(F.size("scores") == k).select("q", F.element_at("scores", k).alias("cutoff")).toArrow()
        cutoffs = np.ones(len(block.ids), np.int64)
        cutoffs[kth.column("q").to_numpy()] = np.maximum(1, kth.column("cutoff").to_numpy())
        names = spark.createDataFrame(pa.table({"q": pa.array(range(len(block.ids)), pa.int32()), "item_id": pa.array(block.ids, rows.schema.field("item").type)}))
        with batches_of(spark, BATCH):
            found = materialise(ranked(lists, block, cutoffs, k), "ranked")
        found = found.join(F.broadcast(names), "q").select("item_id", "doc_id", "score")
        release(lists)
        parts.append(found)
    kind = items.schema[id_col].dataType.simpleString()
    found = parts[0] if parts else spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", F.expr(f"nullif(doc_id, {_NO_ID}L)").alias("doc_id"), "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    with batches_of(spark, BATCH):
        index = materialise(build_index(table(spark, sf_dir, "documents")), "index", **LONG_ROWS)
    return search(index, table(spark, sf_dir, "benchmark"), k=10)


_SQL_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
with asked as (
  select distinct item_id, unnest({_SQL_TERMS}) as term from benchmark
), d as (
  select row_number() over () as r, doc_id, {_SQL_TERMS} as w from documents
), facts as (
  select count(*) as n, cast(sum(len(w)) as bigint) as l from d where len(w) > 0
), posting as (
  select r, term, count(*) as tf from (select r, unnest(w) as term from d) where term in (select term from asked) group by all
), weight as (
  select term, cast(floor(1000 * ln(cast(2 * n + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as weight from posting, facts group by term, n
), m as (
  select r, doc_id, 100 - 90 + ((90 * cast(len(w) as bigint) * n) // l) as m from d, facts where len(w) > 0
), score as (
  select item_id, r, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asked join posting using (term) join weight using (term) join m using (r) group by all
)
select item_id, cast(rank as integer) as "rank", doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from score where score > 0) where rank <= 10
"""


def brute_force(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document with every item; for tests."""
    counts = [(i, Counter(alnum_words((t or "").encode()))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, words = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(alnum_words((text or "").encode()))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counts:
            m = 100 - 90 + 90 * c.total() * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out
