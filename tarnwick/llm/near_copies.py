"""Near copies by the overlap of five-word shingles: every link has a Jaccard similarity of 0.8 or more.

Candidates come from deletion-variant signatures, as in `near_dup`, but of minima in place of bits: at a similarity of 0.8
about ten of 64 bits differ, and segments of so few bits select nothing. A signature is 54 minima in nine segments of six.
Of a segment each position in turn is blanked, which makes six keys, so two texts share a key
(a band, below) where a segment differs in one minimum at most. A pair at 0.8 does in one segment or more with a
probability of 0.99993, one at 0.9 with more than 0.99999998. Every candidate is then verified on the shingle sets themselves.

Rows of equal shingle sets are collapsed first. Each member of a band meets three representatives of it: the
first row, and the first and the last in the order of a hash of the row. So candidates grow with the rows of a band, however
dense it is. What representatives leave apart is settled exactly: of bands whose rows then aren't all in
one component, the rows of different components meet in blocks of about `BLOCK` by `BLOCK` rows, dealt by a hash, so
that no group is taken whole by one task. A block leaves nothing but links between components.
A bit of each minimum keeps pairs far from 0.8 out: a pair at 0.8 differs in 12.5 of 125 bits on average and is let
through up to `FAR`, almost six standard deviations more.

Defined cases: words are lowered as in `near_dup`; a text of fewer words than a shingle is one
shingle; null and empty texts and those of white space only are copies of each other. Sets hold 32 of
the 64 bits of a shingle's hash. A null id never names a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.batches import among, lower_words, map_batches, texts
from tarnwick.llm.near_dup import kept, mark
from tarnwick.operators.graph import components
from tarnwick.session import materialise, release

WORDS = 5
SIMILARITY = 0.8
#: Segments of a signature, and minima of each, of which one is blanked.
SEGMENTS, LENGTH = 9, 6
#: Keys of a signature.
BANDS = SEGMENTS * LENGTH
#: All minima of a set, of which the first make up its signature and each gives a bit.
MINIMA = 125
#: Of these bits as many may differ.
FAR = 32
#: Shingles taken at a time.
STEP = 1 << 12
#: In bands of so many rows every pair has met by representatives.
MET = 3
#: Rows and shingles on each side of a block, about; a heavier band is dealt to more blocks.
BLOCK, WEIGHT = 1 << 10, 1 << 20

_draw = np.random.default_rng(42)
_FACTORS = _draw.integers(0, 2**63, 64, dtype=np.uint64) * 2 + 1
_TIMES = (_draw.integers(0, 2**63, MINIMA, dtype=np.uint64) * 2 + 1)[:, None]
_PLUS = _draw.integers(0, 2**63, MINIMA, dtype=np.uint64)[:, None]
_MIX = np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The different hashes of all word shingles in order."""
    tokens = lower_words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(t, 42) for t in tokens], np.uint64)
    n = max(1, len(each) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(words, len(each))):
        total += each[k : k + n] * _FACTORS[k]
    return np.unique(_mixed(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    """For each of MINIMA orders the smallest element of a set that isn't empty."""
    low = np.full(MINIMA, 2**64 - 1, np.uint64)
    for start in range(0, len(hashes), STEP):
        np.minimum(low, (hashes[start : start + STEP] * _TIMES + _PLUS).min(1), out=low)
    return low


def variants(low: np.ndarray) -> np.ndarray:
    """The BANDS keys of minima: of each segment one for each position, which is left out; the position is part of the key."""
    weighted = low[:BANDS].reshape(SEGMENTS, LENGTH) * _FACTORS[:LENGTH]
    blanked = weighted.sum(1, dtype=np.uint64)[:, None] - weighted
    return _mixed(blanked.ravel() + np.arange(BANDS, dtype=np.uint64) * _FACTORS[8])


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, content, n, bits_a, bits_b, bands, hashes) for each row: bands is empty for an empty text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), mark(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    seen = np.uint64(40)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        content, count, bits, bands, sets = [], [], [], [], []
        for text in texts(batch, "text"):
            h = shingles(text)
            content.append(xxhash.xxh64_intdigest(h.tobytes(), 42))
            count.append(len(h))
            sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes())
            if len(h):
                low = minima(h)
                packed = np.packbits(np.pad(((low * _MIX) >> seen).astype(np.uint8) & 1, (0, 128 - MINIMA)))
                bits.append(packed.view(np.int64))
                bands.append(variants(low).view(np.int64))
            else:
                bits.append(np.zeros(2, np.int64))
                bands.append(np.zeros(0, np.int64))
        both = np.array(bits, np.int64).reshape(-1, 2)
        ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
        columns = [batch.column(0), batch.column(1), pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(count, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])]
        columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands))), pa.array(sets, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "content", "n", "bits_a", "bits_b", "bands", "hashes"])

    return map_batches(docs, run, "doc_id long, mark long, content long, n int, bits_a long, bits_b long, bands array<long>, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of (a, b) those whose sets agree in `least` of their union or more."""
    pairs = materialise(pairs, "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row"))
    # picked without a join, which would shuffle the sets of all rows
    sets = materialise(among(sets.select("row", "hashes"), ends, "row"), "sets")
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(shared >= least * (len(x) + len(y) - shared))
        keep = pa.array(keep, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    links = materialise(map_batches(both.select("a", "b", "x", "y"), run, "a long, b long"), "links")
    release(pairs, sets)
    return links


def _apart(keys: DataFrame, runs: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, row, n, bits_a, bits_b, root, parts): the bands whose rows aren't all in one component."""
    dense = runs.filter(f"size > {MET}").select("key", F.expr(f"cast(greatest(1, ceil(size / {BLOCK}), ceil(weight / {WEIGHT})) as int)").alias("parts"))
    rows = keys.join(dense, "key").join(comps.select(F.col("node").alias("row"), "root"), "row", "left")
    rows = materialise(rows.withColumn("root", F.coalesce("root", "row")), "dense")
    mixed = materialise(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key"), "mixed")
    apart = materialise(rows.join(mixed, "key"), "apart")
    release(rows, mixed)
    return apart


def _close(group: pa.Table, least: float):
    """(i, those of the rows behind it that may be similar and are of another component) for each row i of a block."""
    n, a, b, root, part = (group.column(c).to_numpy() for c in ("n", "bits_a", "bits_b", "root", "part"))
    # the count of a negative number's bits would be that of its absolute value
    a, b = a.view(np.uint64), b.view(np.uint64)
    across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
    for i in range(len(n) - 1):
        rest = slice(i + 1, None)
        far = np.bitwise_count(a[rest] ^ a[i]).astype(np.int64) + np.bitwise_count(b[rest] ^ b[i])
        fits = (far <= FAR) & (root[rest] != root[i]) & (np.minimum(n[rest], n[i]) >= least * np.maximum(n[rest], n[i]))
        if across:
            fits &= part[rest] != part[i]
        hits = np.flatnonzero(fits) + i + 1
        if len(hits):
            yield i, hits


_BLOCK = "key long, i int, j int, part int, row long, root long, n int, bits_a long, bits_b long"


def _crossing(apart: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links between components among the rows of `apart`, as forests of blocks."""
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    rows = apart.withColumn("part", part).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})

    def candidates(group: pa.Table) -> pa.Table:
        active = np.zeros(group.num_rows, bool)
        for i, hits in _close(group, least):
            active[i] = True
            active[hits] = True
        return group.filter(pa.array(active))

    names = [c.split()[0] for c in _BLOCK.split(", ")]
    near = materialise(rows.select(*names).groupBy("key", "i", "j").applyInArrow(candidates, _BLOCK), "near")

    def links(group: pa.Table) -> pa.Table:
        key, root = group.column("key")[0].as_py(), group.column("root").to_numpy()
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        own = [np.frombuffer(x, np.uint32) for x in group.column("hashes").to_pylist()]
        head: dict[int, int] = {}

        def top(x: int) -> int:
            while x in head:
                x = head[x]
            return x

        found = []
        for i, hits in _close(group, least):
            # a pair is compared in the first band it shares
            first = (bands[hits] == bands[i]).argmax(1)
            for j in hits[bands[i][first] == key].tolist():
                x, y = top(int(root[i])), top(int(root[j]))
                if x == y:
                    continue
                shared = len(np.intersect1d(own[i], own[j], assume_unique=True))
                if shared >= least * (len(own[i]) + len(own[j]) - shared):
                    head[max(x, y)] = min(x, y)
                    found.append((int(root[i]), int(root[j])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    wanted = materialise(among(sets.select("row", "bands", "hashes"), near.select("row"), "row"), "sets")
    out = materialise(near.join(wanted, "row").groupBy("key", "i", "j").applyInArrow(links, "a long, b long").distinct(), "crossing")
    release(near, wanted)
    return out


def _grouped(docs: DataFrame, *, id_col: str, text_col: str, least: float) -> DataFrame:
    """(doc_id, mark, fp, component_id, root) for each row of `docs`."""
    rows = materialise(sketches(docs, id_col=id_col, text_col=text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    whole = materialise(rows.groupBy("content").agg(F.min("row").alias("row"), F.min("doc_id").alias("first")), "contents")
    keys = rows.join(whole.select("row"), "row", "left_semi").select("row", "n", "bits_a", "bits_b", F.explode("bands").alias("key"))
    every = materialise(keys, "bands")
    # most keys are those of one row: they go before anything but the key is dealt out for them
    several = materialise(every.groupBy("key").count().filter("count > 1").select("key"), "several")
    keys = materialise(every.join(several, "key"), "shared")
    release(every, several)
    member = ("row", "n", "bits_a", "bits_b")
    shuffled = F.struct(F.xxhash64("row").alias("h"), *member)
    reps = [F.min(F.struct(*member)), F.min(shuffled), F.max(shuffled)]
    runs = keys.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), *(r.alias(f"r{i}") for i, r in enumerate(reps))).filter("size > 1")
    # a written table is a plain side of the join, which Spark can split on the other
    runs = materialise(runs.select("key", "size", "weight", F.array(*(F.struct(*(f"r{i}.{m}" for m in member)) for i in range(len(reps)))).alias("reps")), "runs")
    met = keys.join(runs, "key").select(*member, F.explode("reps").alias("rep")).filter("row != rep.row")
    sized = f"least(n, rep.n) >= {least} * greatest(n, rep.n)"
    far = f"bit_count(bits_a ^ rep.bits_a) + bit_count(bits_b ^ rep.bits_b) <= {FAR}"
    pairs = met.filter(f"{sized} and {far}").select(F.least("row", "rep.row").alias("a"), F.greatest("row", "rep.row").alias("b")).distinct()
    links = _verified(pairs, rows, least)
    found = components(links)
    apart = _apart(keys, runs, found)
    release(keys, runs)
    rooted = whole.join(found.select(F.col("node").alias("row"), "root"), "row", "left").select("content", "first", F.coalesce("root", "row").alias("root"))
    if not apart.isEmpty():
        further = components(_crossing(apart, rows, least)).select(F.col("node").alias("root"), F.col("root").alias("top"))
        rooted = rooted.join(further, "root", "left").select("content", "first", F.coalesce("top", "root").alias("root"))
    release(apart)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(smallest, "root").select("content", "component_id", "root")
    return rows.select("doc_id", "mark", "content").join(of, "content").select("doc_id", "mark", F.col("content").alias("fp"), "component_id", "root")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`: fp stands for its set of shingles, and component_id
    is the smallest doc_id reachable over similarities of `least` or more."""
    return _grouped(docs, id_col=id_col, text_col=text_col, least=least).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each group of near copies, that of the smallest id; columns unchanged."""
    return kept(docs, _grouped(docs, id_col=id_col, text_col=text_col, least=least), id_col, text_col)


def brute_force(docs: list[tuple], words: int = WORDS, least: float = SIMILARITY) -> tuple[dict, set]:
    """doc_id -> component, and the linked pairs, by comparing all sets of shingles; for tests."""
    sets = {}
    for doc, text in docs:
        tokens = (text or "").encode().lower().split()
        sets[doc] = frozenset(tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1)) if tokens)
    pairs = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
    group, changed = {d: d for d in sets}, True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group, pairs
