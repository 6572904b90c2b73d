"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in three
bits or fewer, one half differs in at most one, so the two share a variant of that half
with one position blanked: 32 variants per half, 64 keys per distinct fingerprint. An
equality join on the key finds every candidate, and the whole fingerprints are compared.

Copies of one fingerprint are collapsed first. Within a key, what leaves a task is not the
pairs but a spanning forest of the links found, so a dense group of near copies yields as
many rows as it has members. A key with more than `HOT` fingerprints is spread over 1,024
finer keys: of the 32 bits of the other half at most three differ, so one of its four bytes
is equal.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and is
linked like any other; a text of fewer words than a shingle is one shingle. Rows that share
a doc_id are rows of their own in the fingerprints. A null id never names a component.
`keep_one` keeps rows with a null id and one row of each group, known by its id and text: other texts of
the same id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm.batches import lower_words, map_batches, texts
from tarnwick.operators.graph import components
from tarnwick.session import materialise, table

WORDS = 3
BITS = 3
HOT = 20_000
#: Shingles, or rows of a sorted key run, taken at a time.
STEP = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The majority of each bit over the XXH64 (seed 42) of all word shingles, repeats included."""
    tokens = lower_words(text)
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    digest, joined = xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(64, np.int64)
    for start in range(0, n, STEP):
        hashes = np.array([digest(joined(tokens[i : i + words]), 42) for i in range(start, min(n, start + STEP))], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def mark(text_col: str) -> Column:
    """A hash of the text as it stands, which tells rows of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, marked: bool = False) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for each row; where `marked`, (doc_id, mark, fp)."""
    own = [F.col(id_col).cast("long").alias("doc_id"), *([mark(text_col).alias("mark")] if marked else [])]
    docs = docs.select(*own, F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, words) for t in texts(batch, "text")], np.uint64).view(np.int64)
        names = batch.schema.names[:-1]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(found)], [*names, "fp"])

    return map_batches(docs, run, f"doc_id long, {'mark long, ' if marked else ''}fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, sub, fp): 64 one-wildcard keys for each fingerprint; sub is -1 but for hot keys."""
    exploded = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    key = "((case when i < 32 then fp else shiftrightunsigned(fp, 32) end) & 4294967295L & ~shiftleft(1L, i % 32)) | shiftleft(cast(i as bigint), 32)"
    return exploded.select(F.expr(key).alias("key"), F.lit(-1).alias("sub"), "fp")


def _spread(keys: DataFrame) -> DataFrame:
    """Keys with more than HOT fingerprints become four finer keys each row, by a byte of the other half."""
    hot = keys.groupBy("key").count().filter(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    if hot.isEmpty():
        return keys
    marked = keys.join(hot, "key", "left")
    byte = "(shiftrightunsigned(fp, (case when shiftright(key, 32) < 32 then 32 else 0 end) + 8 * j) & 255)"
    fine = marked.filter("hot").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return marked.filter("hot is null").select("key", "sub", "fp").unionByName(fine.select("key", F.expr(f"cast(256 * j + {byte} as int)").alias("sub"), "fp"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of linked fingerprints each but the smallest of its group, with that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _runs(key: np.ndarray, sub: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by (key, sub), as a forest."""
    found_a, found_b, held = [], [], 0
    at, d = np.arange(len(key)), 0
    while True:
        d += 1
        at = at[at + d < len(key)]
        at = at[(key[at] == key[at + d]) & (sub[at] == sub[at + d])]
        if not len(at):
            break
        near = np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= bits
        found_a.append(fp[at[near]])
        found_b.append(fp[at[near] + d])
        held += int(near.sum())
        if held > 4 * STEP:  # a dense run: what is found so far shrinks to a forest
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], 0
    if not found_a:
        return fp[:0], fp[:0]
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links between different fingerprints, a spanning forest of each run of equal keys.

    `fps` has one row for each distinct fingerprint.
    """
    if bits > 3:
        raise ValueError("two halves with one blank each find links of at most three bits")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def search(last: bool) -> pa.RecordBatch | None:
            key, sub, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            # the last run may go on in the next batch
            cut = len(key) if last else int(np.flatnonzero((key != key[-1]) | (sub != sub[-1])).max(initial=-1)) + 1
            held[:] = [] if cut == len(key) else [[key[cut:], sub[cut:], fp[cut:]]]
            a, b = _runs(key[:cut], sub[:cut], fp[:cut], bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

        for batch in it:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if sum(len(x[0]) for x in held) >= STEP and (out := search(False)):
                yield out
        if held and (out := search(True)):
            yield out

    keys = _spread(variants(fps))
    return keys.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp").mapInArrow(run, "a long, b long")


def grouped(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of (doc_id, fp, ...) with component_id, the smallest doc_id reachable over links, and root, which names the component."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    found = components(links(distinct.select("fp"), bits)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(smallest, "root").select("fp", "component_id", "root")
    return prints.join(of, "fp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`; other columns are not read."""
    return grouped(materialise(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "prints"), bits).select("doc_id", "fp", "component_id")


def kept(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with one row for each root in `rows`, which has (doc_id, mark, component_id, root); columns unchanged.

    A row is known by its id and the mark of its text: ids may clash. Of a component the smallest id stays, of its
    texts that of the smallest mark, and of rows that share both the first in the order of their JSON.
    """
    sized = rows.filter("doc_id = component_id").groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n"))
    best = sized.groupBy("root").agg(F.min(F.struct("doc_id", "mark", "n")).alias("best")).select("best.*")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), mark(text_col).alias("mark"))
    order = F.when(F.col("n") > 1, F.to_json("row")).otherwise("")
    one = packed.join(best, ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(F.min_by("row", order).alias("row")).select("row.*")
    return one.unionByName(docs.filter(F.col(id_col).isNull()))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """`docs` with one row of each group of near copies, that of the smallest id; columns unchanged."""
    prints = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, marked=True), "prints")
    return kept(docs, grouped(prints, bits), id_col, text_col)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole document: three-word shingles, three bits."""
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple], words: int = WORDS, bits: int = BITS) -> dict:
    """doc_id -> (fingerprint, component) by comparing all pairs; for tests."""
    prints = {}
    for doc, text in docs:
        tokens = (text or "").encode().lower().split()
        shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[doc] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    group = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for x in prints:
            for y in prints:
                if bin(prints[x] ^ prints[y]).count("1") <= bits and group[y] > group[x]:
                    group[y], changed = group[x], True
    return {d: (f"{p:016x}", group[d]) for d, p in prints.items()}
