"""Similarity join of documents on sets of word shingles, by adaptive multi-match prefixes.

A set's shingles are put in one order for all documents, the rare ones first: by the magnitudes of their words' counts over
all documents (in 2 ** `BUCKETS` buckets), then by hash. Two sets of a Jaccard similarity of
`PERCENT` share at least that part of either's size, so of a set of n shingles and least overlap t
the first n - t + l hold at least l of those shared: the l-prefix. Each document chooses
its l from 1 to `MOST` by cost: the postings it meets in the l-prefix, and the candidates they
leave, at most 1 / l of them, times the price of a verification. Documents with different l share at
least the smaller number of prefix shingles; candidates with fewer are never verified.

Equal sets are collapsed before. Then, for each prefix shingle that several sets hold,

1. every set meets the first of them: as many pairs as sets, whatever the group. What is verified
   links a dense group of near copies into one component;
2. where at most `SMALL` sets hold the shingle all pairs are formed, counted over the shared prefix shingles, and
   those of different components are verified if they share enough;
3. sets that meet in more frequent shingles, but not in one component, are compared by blocks: families of such sets
   are cut into chunks in order of size, and pairs of chunks whose sizes allow a link are compared
   within a task, exactly, pairs of one component left out. What leaves is a spanning forest of the links.

A set's print has two to four bits for each shingle, each the parity of the shingles that fall on it. Two prints differ in no more
bits than the sets in shingles, so pairs whose prints differ in more bits than a link allows go before any set is
sent to meet another; neither a pair nor a chunk carries anything else until then.

So no link is lost, and no step writes all pairs of a group. Sets are verified on their 64-bit shingle hashes,
which a further pass over the texts gives, for documents whose content is in a bitmap of 2 ** `BITMAP` bits.

Defined cases: A-Z is lowered; a text of fewer words than a shingle is one shingle; a null text, an empty one and
one of white space have no shingle and are linked with nothing, not even each other; rows of one doc_id
are documents of their own; a null id never names a component (unless all ids of it are null);
further columns are not read; ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.llm.batches import among, bitmap, lower_words, map_batches, texts
from tarnwick.llm.merkle import placed
from tarnwick.llm.near_copies import _FACTORS, _mixed
from tarnwick.operators.graph import components
from tarnwick.session import materialise, release, table

WORDS, PERCENT = 3, 90
#: The longest prefix has as many shingles beyond the shortest, and one.
MOST = 4
#: A verification costs as many postings, and one more for each so many shingles.
VERIFY, PER = 4, 64
#: Sets that hold a shingle, up to which their pairs are formed.
SMALL = 64
#: Buckets of counts and bits of the content bitmap, as powers of two; counts and bitmap reach the driver.
BUCKETS, BITMAP = 18, 26
#: Contents that a task remembers, to give equal ones once.
SEEN = 1 << 20
_CHUNK = 4096


def content(hashes: np.ndarray) -> int:
    """The name of a set: a signed 64-bit hash of its shingles in order."""
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), 42)], np.uint64).view(np.int64)[0])


def shingled(text: bytes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words in order, the different hashes of all shingles in order, and where each stands first."""
    tokens = lower_words(text)
    each = np.fromiter(map(_word, tokens), np.uint64, len(tokens))
    if not len(each):
        return each, each, np.zeros(0, np.int64)
    n = max(1, len(each) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(words, len(each))):
        total += each[k : k + n] * _FACTORS[k]
    return each, *np.unique(_mixed(total), return_index=True)


def _word(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, 42)


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BUCKETS)).view(np.int64)


def least_overlap(n: int) -> int:
    """The fewest shingles that a set of n must share with any partner."""
    return (PERCENT * n + 99) // 100


def parity(hashes: np.ndarray) -> np.ndarray:
    """The print of a set, as 64-bit words: a power of two of bits, as many for all sizes of one magnitude."""
    bits = max(64, 2 << len(hashes).bit_length())
    odd = (np.bincount((hashes & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(prints: np.ndarray, words: int) -> np.ndarray:
    """Prints, one a row or a single one, as those of the same sets in so many words."""
    while prints.shape[-1] > words:
        half = prints.shape[-1] // 2
        prints = prints[..., :half] ^ prints[..., half:]
    return prints


def apart_by(bits: np.ndarray | int, n: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of n shingles together, whose prints differ in so many bits, are too far apart for a link."""
    return (100 + PERCENT) * bits > (100 - PERCENT) * n


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def sized(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, content, n) of each row, and the magnitude of each bucket's count of words over all rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKETS, np.int64)
        names = ["doc_id", "content", "n", "chunk", "counts"]
        held: list[np.ndarray] = []

        def count() -> None:
            counts[:] += np.bincount(np.concatenate(held), minlength=1 << BUCKETS)
            held.clear()

        for batch in it:
            names_, sizes, size = [], [], 0
            for text in texts(batch, "text"):
                each, h, _ = shingled(text, words)
                held.append(_bucket(each))
                size += len(each)
                if size > 1 << 20:
                    count()
                    size = 0
                names_.append(content(h))
                sizes.append(len(h))
            if held:
                count()
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names_, pa.int64()), pa.array(sizes, pa.int64()), *none], names)
        parts = counts.reshape(-1, _CHUNK)
        used = np.flatnonzero(parts.any(1))
        none = [pa.nulls(len(used), pa.int64())] * 3
        if len(used):
            yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names)

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, np.int64)
        for x in group.column("counts").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    both = materialise(docs.mapInArrow(run, "doc_id long, content long, n long, chunk int, counts binary"), "sized")
    parts = both.filter("chunk is not null").select("chunk", "counts")
    # in two steps, so that no group holds the counts of all tasks
    parts = parts.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 41)).groupBy("chunk", "part").applyInArrow(added, "chunk int, counts binary")
    whole = np.zeros((1 << BUCKETS) // _CHUNK * _CHUNK, np.int64).reshape(-1, _CHUNK)
    for row in parts.groupBy("chunk").applyInArrow(added, "chunk int, counts binary").toArrow().to_pylist():
        whole[row["chunk"]] = np.frombuffer(row["counts"], np.int64)
    magnitude = np.round(4 * np.log2(1.0 + whole.ravel())).astype(np.int16)
    return both.filter("chunk is null").select("doc_id", "content", "n"), magnitude


def prefixes(docs: DataFrame, magnitude: np.ndarray, words: int) -> DataFrame:
    """(content, n, tokens, print) for each different set that isn't empty: its longest prefix, in order, and its print."""
    shared = docs.sparkSession.sparkContext.broadcast(magnitude)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = shared.value, set()
        for batch in it:
            names, sizes, tokens, prints = [], [], [], []
            for text in texts(batch, "text"):
                each, h, at = shingled(text, words)
                if not len(h) or (name := content(h)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(name)
                level = np.concatenate([rank[_bucket(each)], np.zeros(words - 1, np.int16)])
                # sorted by hash, so a stable order by magnitude is one by both
                order = np.argsort(sum(level[at + k] for k in range(words)), kind="stable")
                names.append(name)
                sizes.append(len(h))
                tokens.append(h[order[: len(h) - least_overlap(len(h)) + MOST]].view(np.int64))
                prints.append(parity(h).tobytes())
            if names:
                columns = [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(prints, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["content", "n", "tokens", "print"])

    found = docs.mapInArrow(run, "content long, n long, tokens array<long>, print binary")
    return found.groupBy("content").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "print")))


def adapted(sets: DataFrame) -> DataFrame:
    """(token, content, n, need, hot): the postings of each set's own prefix, for tokens that several sets hold.

    need is the set's l, always `MOST` where it meets a token of more than `SMALL` sets; hot is the number of those in its prefix.
    Sets of fewer shingles than `MOST` are similar to equal ones alone, and those are collapsed.
    """
    posted = sets.select("content", "n", F.posexplode("tokens").alias("pos", "token"))
    df = materialise(posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    met = posted.join(df, "token")
    shortest = f"n - ({PERCENT} * n + 99) div 100 + 1"
    own = Window.partitionBy("content")
    costs = []
    for l in range(1, MOST + 1):
        postings = F.sum(F.expr(f"if(pos < {shortest} + {l - 1}, df - 1, 0L)")).over(own)
        costs.append(F.struct((postings + postings / l * (VERIFY + F.col("n") / PER)).alias("cost"), F.lit(l).alias("need")))
    busy = F.max(F.expr(f"df > {SMALL}")).over(own)
    chosen = met.select("token", "content", "n", "pos", "df", F.when(busy, MOST).otherwise(F.least(*costs).getField("need")).alias("need"))
    chosen = chosen.filter(f"pos < {shortest} + need - 1")
    return chosen.select("token", "content", "n", "need", F.sum(F.expr(f"cast(df > {SMALL} as int)")).over(own).alias("hot"), (F.col("df") > SMALL).alias("busy"))


def set_hashes(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(content, print, hashes) for at least the contents in `wanted`: a bitmap of them keeps back most others."""
    bits = bitmap(wanted.select(F.expr(f"content & {(1 << BITMAP) - 1}L").alias("bit")), BITMAP)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, set()
        for batch in it:
            names, prints, sets = [], [], []
            for text in texts(batch, "text"):
                _, h, _ = shingled(text, words)
                if not len(h) or (name := content(h)) in seen:
                    continue
                bit = name & ((1 << BITMAP) - 1)
                if known[bit >> 3] >> (bit & 7) & 1:
                    if len(seen) < SEEN:
                        seen.add(name)
                    names.append(name)
                    prints.append(parity(h).tobytes())
                    sets.append(h.tobytes())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], ["content", "print", "hashes"])

    found = docs.mapInArrow(run, "content long, print binary, hashes binary")
    return found.groupBy("content").agg(*(F.first(c).alias(c) for c in ("print", "hashes")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("content"))


def near(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Of (a, b) those whose prints, of (content, n, print), allow a link, as a written table."""
    x, y = (prints.select(F.col("content").alias(c), F.col("n").alias(f"n_{c}"), F.col("print").alias(f"p_{c}")) for c in "ab")
    both = pairs.select("a", "b").join(x, "a").join(y, "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = []
        for p, q in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            words = min(len(p), len(q))
            bits.append(int(np.bitwise_count(folded(p, words) ^ folded(q, words)).sum(dtype=np.int64)))
        keep = pa.array(~apart_by(np.array(bits, np.int64), batch.column(2).to_numpy()))
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return materialise(map_batches(both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "p_a", "p_b"), run, "a long, b long"), "near")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b) those whose sets are similar, as a written table."""
    pairs = materialise(pairs.select("a", "b"), "candidates")
    sets = among(sets.select("content", "hashes"), _ends(pairs), "content")
    both = pairs.join(sets.select(F.col("content").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("content").alias("b"), F.col("hashes").alias("y")), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = pa.array([similar(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(x, y, strict=True)], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return materialise(map_batches(both.select("a", "b", "x", "y"), run, "a long, b long"), "links")


_FITS = f"100 * least(n, other.n) >= {PERCENT} * greatest(n, other.n)"


def _counted(met: DataFrame, need: str) -> DataFrame:
    """(a, b) of (content, n, need, hot, other) met in a token each, where they share as many tokens as `need`."""
    pairs = met.select(F.least("content", "other.content").alias("a"), F.greatest("content", "other.content").alias("b"), F.expr(need).alias("need"))
    return pairs.groupBy("a", "b", "need").count().filter("count >= need").select("a", "b")


def stars(runs: DataFrame) -> DataFrame:
    """(a, b): every set of a token with the first of them."""
    first = runs.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("content", "n", "need")).alias("other"))
    first = materialise(first.filter("size > 1").drop("size"), "first")
    return _counted(runs.join(first, "token").filter(f"content != other.content and {_FITS}"), "least(need, other.need)")


def pairs(runs: DataFrame) -> DataFrame:
    """(a, b): all pairs of tokens that at most SMALL sets hold, where these and as many busy ones as both have make up the need."""
    small = runs.filter("not busy").drop("busy")
    others = small.select("token", F.struct("content", "n", "need", "hot").alias("other"))
    return _counted(small.join(others, "token").filter(f"content < other.content and {_FITS}"), "least(need, other.need) - least(hot, other.hot)")


def named(rows: DataFrame, comps: DataFrame, col: str, name: str) -> DataFrame:
    """`rows` with `name`, the component of the content in `col`: itself where it has no link."""
    of = comps.select(F.col("node").alias(col), F.col("root").alias("__root"))
    return rows.join(of, col, "left").withColumn(name, F.coalesce("__root", col)).drop("__root")


def apart(big: DataFrame, comps: DataFrame) -> DataFrame:
    """(token, content, n, need, comp): the postings of tokens whose sets aren't all in one component."""
    rows = materialise(named(big, comps, "content", "comp"), "named")
    tokens = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("token")
    return materialise(rows.join(materialise(tokens, "tokens"), "token"), "apart")


def blocks(big: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(a, b): links of different components among the sets of the postings `big`, as forests; None if there are no such."""
    if big.isEmpty():
        return None
    first = materialise(big.groupBy("token").agg(F.min("content").alias("first")), "first")
    family = components(big.join(first, "token").select(F.col("content").alias("a"), F.col("first").alias("b")))
    rows = big.select("content", F.col("n").alias("n_tokens"), "comp").distinct().join(family.select(F.col("node").alias("content"), F.col("root").alias("family")), "content")
    rows = placed(rows, "family", ["n_tokens", "content"], "members")
    # chunks of about 2 ** 21 shingles, in order of size; all prints of a chunk have as many bits
    kind = "cast(log2(n_tokens) as int)"
    rows = rows.withColumn("chunk", F.expr(f"shiftleft(cast({kind} as bigint), 48) + shiftright(at, least(12, greatest(0, 21 - {kind})))"))
    rows = materialise(rows.select("family", "chunk", "content", "n_tokens", "comp"), "chunks")
    facts = rows.groupBy("family", "chunk").agg(F.min("n_tokens").alias("low"), F.max("n_tokens").alias("high"), F.min("comp").alias("c"), F.max("comp").alias("d"))
    facts = materialise(facts, "facts")
    later = facts.select("family", *(F.col(c).alias(f"{c}2") for c in facts.columns[1:]))
    fits = f"chunk <= chunk2 and 100 * high >= {PERCENT} * low2 and not (c = d and c2 = d2 and c = c2)"
    units = materialise(facts.join(later, "family").filter(fits).select("family", "chunk", "chunk2").withColumn("unit", F.monotonically_increasing_id()), "units")
    sides = F.explode(F.array_distinct(F.array("chunk", "chunk2")))
    met = rows.join(units.select("unit", "family", sides.alias("chunk"), (F.col("chunk") != F.col("chunk2")).alias("two"), F.col("chunk").alias("low")), ["family", "chunk"])
    met = met.select("unit", (F.col("two") & (F.col("chunk") != F.col("low"))).alias("second"), "two", "comp", "content", "n_tokens")
    met = met.join(sets.select("content", "print"), "content").select("unit", "second", "two", "comp", "content", "n_tokens", "print")

    def close(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """(i, those it may be linked with and that are of another component) for each row i of a unit, or of its first chunk."""
        n, comps = group.column("n_tokens").to_numpy(), group.column("comp").to_numpy()
        prints = [np.frombuffer(x, np.uint64) for x in group.column("print").to_pylist()]
        words = min(map(len, prints))
        prints = np.array([folded(x, words) for x in prints])
        second = group.column("second").to_numpy(zero_copy_only=False)
        two = bool(group.column("two")[0].as_py())
        left = np.flatnonzero(~second) if two else np.arange(len(n))
        right = np.flatnonzero(second) if two else left
        for at, i in enumerate(left.tolist()):
            rest = right if two else right[at + 1 :]
            rest = rest[(comps[rest] != comps[i]) & (100 * np.minimum(n[rest], n[i]) >= PERCENT * np.maximum(n[rest], n[i]))]
            if len(rest):
                bits = np.bitwise_count(prints[rest] ^ prints[i]).sum(1, dtype=np.int64)
                if len(hits := rest[~apart_by(bits, n[rest] + n[i])]):
                    yield i, hits

    def candidates(group: pa.Table) -> pa.Table:
        active = np.zeros(group.num_rows, bool)
        for i, hits in close(group):
            active[i] = True
            active[hits] = True
        return group.filter(pa.array(active))

    active = materialise(met.groupBy("unit").applyInArrow(candidates, met.schema), "active")
    wanted = among(sets.select("content", "hashes"), active, "content")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        comps, names = group.column("comp").to_numpy(), group.column("content").to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        head: dict[int, int] = {}

        def top(x: int) -> int:
            while x in head:
                x = head[x]
            return x

        a, b = [], []
        for i, hits in close(group):
            for j in hits.tolist():
                x, y = top(int(comps[i])), top(int(comps[j]))
                if x != y and similar(own[i], own[j]):
                    head[max(x, y)] = min(x, y)
                    a.append(names[i])
                    b.append(names[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = active.join(wanted, "content").select("unit", "second", "two", "comp", "content", "n_tokens", "print", "hashes")
    return materialise(met.groupBy("unit").applyInArrow(compare, "a long, b long"), "blocks")


def joined(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`: the smallest id reachable over links, itself included."""
    docs = _texts(docs, id_col, text_col)
    rows, magnitude = sized(docs, words)
    found = materialise(prefixes(docs, magnitude, words), "prefixes")
    runs = materialise(adapted(found), "runs")
    tested = materialise(stars(runs), "stars")
    close = materialise(pairs(runs), "pairs")
    # pairs that share no other tokens share as many busy ones as the need, which is MOST for both
    big = materialise(runs.filter(f"busy and hot >= {MOST}"), "big")
    prints = materialise(among(found.select("content", "n", "print"), _ends(tested.unionByName(close)), "content"), "prints")
    tested, close = near(tested, prints), near(close, prints)
    release(found, prints)
    wanted = _ends(tested.unionByName(close)).unionByName(big.select("content")).distinct()
    sets = materialise(set_hashes(docs, wanted, words), "sets")
    links = verified(tested, sets)
    comps = components(links)
    rest = named(named(close.join(tested, ["a", "b"], "left_anti"), comps, "a", "x"), comps, "b", "y").filter("x != y")
    more = [verified(rest, sets)]
    if (found := blocks(apart(big, comps), sets)) is not None:
        more.append(found)
    more = [m for m in more if not m.isEmpty()]
    if more:
        for m in more:
            links = links.unionByName(m)
        comps = components(links)
    release(sets, runs)
    whole = materialise(rows.filter("n > 0").groupBy("content").agg(F.min("doc_id").alias("first")), "contents")
    rooted = materialise(whole.join(comps.select(F.col("node").alias("content"), "root"), "content", "left").select("content", "first", F.coalesce("root", "content").alias("root")), "rooted")
    smallest = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    of = materialise(rooted.join(smallest, "root").select("content", "component_id"), "of")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").join(of, "content").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every whole document: three-word shingles, a similarity of 0.9 or more."""
    return joined(table(spark, sf_dir, "documents"))


OP13_SQL = """
with recursive d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), shingle as (
  select distinct r, array_to_string(w[i + 1:i + least(3, len(w))], ' ') as s
  from (select r, w, unnest(range(greatest(1, len(w) - 2))) as i from d where len(w) > 0)
), size as (
  select r, count(*) as n from shingle group by r
), link as (
  select x.r as a, y.r as b from shingle x join shingle y on x.s = y.s and x.r <> y.r join size p on p.r = x.r join size q on q.r = y.r
  group by x.r, y.r, p.n, q.n having 100 * count(*) >= 90 * (p.n + q.n - count(*))
), reached(a, b) as (
  select r, r from d union select reached.a, link.b from reached join link on link.a = reached.b
)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, min(o.doc_id) as component_id
from d left join size using (r) join reached on reached.a = d.r join d o on o.r = reached.b
group by d.r, d.doc_id, n
"""


def brute_force(docs: list[tuple], words: int = WORDS) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all sets; for tests."""
    sets = []
    for _, text in docs:
        tokens = (text or "").encode().lower().split()
        sets.append({tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1)) if tokens})
    group = list(range(len(docs)))
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and x and y and 100 * len(x & y) >= PERCENT * len(x | y)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(group[i], group[j])
            changed |= group[i] != low or group[j] != low
            group[i] = group[j] = low
    ids = {}
    for (doc, _), g in zip(docs, group):
        if doc is not None:
            ids[g] = min(doc, ids.get(g, doc))
    return [(doc, len(s), ids.get(g)) for (doc, _), s, g in zip(docs, sets, group)]
