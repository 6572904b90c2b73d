"""Merkle manifest of a dataset with a witness for every row, by incremental appends.

Rows are appended to their group's tree in order. A tree is a row of open subtrees of falling
height. When a subtree gets its sibling both close into their parent, and the sibling's digest is
attached to the partial witnesses of all members of the other one: a witness grows with every
later completion, and nothing is recomputed for it. A node that stays alone at the end of its
level is hashed by itself and adds no sibling.

Appends are aligned in blocks of 2 ** `BITS` rows, which tasks append to apart from each other.
A block's root is a node like any other, so the roots of all blocks are further appends to the
tree above, again in aligned blocks, until each group has one node left. The groups' roots are the
appends of the last tree. A row's witness is its own within the block and, behind it, that of the block's root.

Texts never leave the scan: leaves are digests of built-in functions. What moves is a digest for
each row (one range exchange for the order, one for the blocks); a task holds one block.

Defined cases: a null value is `-` in a leaf; null groups and null ids come first; rows of one id
are ordered by their leaf, so equal rows are interchangeable; columns that aren't named are not
read; an empty table has an empty manifest; the largest n_chars a long can hold stays as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.session import materialise, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a block, as a power of two.
BITS = 12
#: Of a level of a witness: no sibling, one before the node, one after it.
ALONE, BEFORE, AFTER = 0, 1, 2
_STEP = 33


def leaf(values: list[Column]) -> Column:
    """SHA-256, in lowercase hex, of values as byte count, colon and text; `-` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def hashed(*nodes: bytes) -> bytes:
    """The digest, as hex, of digests given as hex."""
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


class Appended:
    """The tree of one aligned block: open subtrees, and the partial witness of each node appended so far."""

    def __init__(self, size: int, height: int) -> None:
        self.witness = np.zeros((size, height, _STEP), np.uint8)
        self.open: list[tuple[int, bytes, int, int]] = []
        self.size = 0

    def append(self, node: bytes) -> None:
        self.open.append((0, node, self.size, self.size + 1))
        self.size += 1
        self._complete()

    def _complete(self) -> None:
        """Siblings of equal height close, and extend the witnesses of each other's members."""
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            level, right, middle, end = self.open.pop()
            _, left, start, _ = self.open.pop()
            self._extend(start, middle, level, AFTER, right)
            self._extend(middle, end, level, BEFORE, left)
            self.open.append((level + 1, hashed(left, right), start, end))

    def _extend(self, start: int, end: int, level: int, side: int, sibling: bytes) -> None:
        self.witness[start:end, level, 0] = side
        self.witness[start:end, level, 1:] = np.frombuffer(bytes.fromhex(sibling.decode()), np.uint8)

    def close(self, height: int) -> bytes:
        """The root at `height`: the last subtree rises alone until it has a sibling or is the only one."""
        while len(self.open) > 1 or self.open[0][0] < height:
            level, node, start, end = self.open.pop()
            self.open.append((level + 1, hashed(node), start, end))
            self._complete()
        return self.open[0][1]


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`rows` with `at`, the place from 0 within the group in `order`, and `n`, the group's rows.

    Ranges of the whole order are sorted apart; a group's part of a range begins where its earlier
    parts end. So a group of most rows is spread over many ranges.
    """
    sorted_ = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranges = materialise(sorted_.withColumn("__i", F.monotonically_increasing_id()), name).withColumn("__part", F.shiftright("__i", 33))
    parts = ranges.groupBy("__part", F.col(group).alias("__g")).agg(F.count("*").alias("__size"), F.min("__i").alias("__first"))
    whole = Window.partitionBy("__g")
    before = F.coalesce(F.sum("__size").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("__part", "__g", (before - F.col("__first")).alias("__shift"), F.sum("__size").over(whole).alias("n")).withColumnRenamed("__part", "__p")
    met = ranges.join(starts, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return met.withColumn("at", F.col("__i") + F.col("__shift")).drop("__i", "__part", "__p", "__g", "__shift")


def _append_blocks(nodes: DataFrame, group: str, keep: list[str]) -> DataFrame:
    """Each of (group, at, n, node, *keep) with its witness within the block, the block's place and the block's root."""
    mask = (1 << BITS) - 1
    fields = [f for f in nodes.schema if f.name in (group, "at", "n", "node", *keep)]
    nodes = nodes.select(*(f.name for f in fields)).repartition(group, F.shiftright("at", BITS)).sortWithinPartitions(group, "at")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            n = whole.column("n")[0].as_py()
            height = min(BITS, (n - 1).bit_length())
            tree = Appended(whole.num_rows, height)
            for node in whole.column("node").cast(pa.binary()).to_pylist():
                tree.append(node)
            root = tree.close(height)
            witness = pa.array([w.tobytes() for w in tree.witness], pa.binary())
            roots = pa.array([root.decode()] * whole.num_rows, pa.string())
            return pa.RecordBatch.from_arrays([*whole.columns, witness, roots], [*whole.schema.names, "witness", "root"])

        for batch in it:
            # places are dense, so every block begins with the first place of it
            starts = [int(i) for i in np.flatnonzero((batch.column(batch.schema.get_field_index("at")).to_numpy() & mask) == 0)]
            for start, end in zip([0, *starts], [*starts, batch.num_rows]):
                if start in starts and held:
                    yield block()
                if end > start:
                    held.append(batch.slice(start, end - start))
        if held:
            yield block()

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return nodes.mapInArrow(run, f"{names}, witness binary, root string")


def trees(nodes: DataFrame, group: str, keep: list[str], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, above, roots) of the trees of all groups.

    `nodes` has (group, at, n, node, *keep); rows have their witness within the block, `above` has (group, block, witness)
    of every block's root up to the group's, and roots (group, node).
    """
    levels = []
    while True:
        level = materialise(_append_blocks(nodes, group, [] if levels else keep), f"{name}-{len(levels)}")
        levels.append(level)
        heads = level.filter(F.col("at") % (1 << BITS) == 0)
        nodes = heads.select(group, F.shiftright("at", BITS).alias("at"), F.expr(f"shiftright(n - 1, {BITS}) + 1").alias("n"), F.col("root").alias("node"))
        if nodes.filter("n > 1").isEmpty():
            break
    above = nodes.select(group, F.col("at").alias("block"), F.lit(b"").cast("binary").alias("witness"))
    for level in reversed(levels[1:]):
        up = above.select(F.col(group).alias("__g"), F.col("block").alias("__b"), F.col("witness").alias("__w"))
        met = level.join(up, F.col(group).eqNullSafe(F.col("__g")) & (F.shiftright("at", BITS) == F.col("__b")))
        above = met.select(group, F.col("at").alias("block"), F.concat("witness", "__w").alias("witness"))
    return levels[0], above, nodes.select(group, "node")


def fold(start: bytes, witness: bytes) -> tuple[bytes, str]:
    """The root that a leaf and its witness give, and the digest of the siblings in order."""
    node, siblings = start, []
    for i in range(0, len(witness), _STEP):
        sibling = witness[i + 1 : i + _STEP].hex().encode()
        if witness[i] == ALONE:
            node = hashed(node)
            continue
        siblings.append(sibling)
        node = hashed(sibling, node) if witness[i] == BEFORE else hashed(node, sibling)
    return node, hashlib.sha256(b"".join(siblings)).hexdigest()


def manifest(leaves: DataFrame, *, group: str = "lang", order: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(group, order, leaf, *keep, subroot, root, witness) for each row of `leaves`, which has (group, order, leaf, *keep).

    The witness has 33 bytes for each level, from the leaf to the root over all groups: the side of the sibling, and its digest.
    """
    kept = [order, *keep]
    nodes = placed(leaves.select(group, "leaf", *kept), group, [order, "leaf"], "ranges").withColumnRenamed("leaf", "node")
    rows, above, subroots = trees(nodes, group, kept, "tree")
    one = placed(subroots.select(F.lit(0).alias("__all"), group, "node"), "__all", [group], "groups")
    tops, higher, last_root = trees(one, "__all", [group], "top")
    found = last_root.first()  # one row, or none of an empty table
    last = higher.select(F.col("block").alias("__b"), F.col("witness").alias("__w"))
    top = tops.join(last, F.shiftright("at", BITS) == F.col("__b"))
    top = top.select(F.col(group).alias("__t"), F.col("node").alias("subroot"), F.concat("witness", "__w").alias("__over"))
    up = above.join(top, F.col(group).eqNullSafe(F.col("__t"))).select(F.col(group).alias("__g"), F.col("block").alias("__b"), "subroot", F.concat("witness", "__over").alias("__w"))
    met = rows.join(up, F.col(group).eqNullSafe(F.col("__g")) & (F.shiftright("at", BITS) == F.col("__b")))
    return met.select(group, *kept, F.col("node").alias("leaf"), "subroot", F.lit(found.node if found else None).cast("string").alias("root"), F.concat("witness", "__w").alias("witness"))


def proved(rows: DataFrame, starts: str, carried: list[str]) -> DataFrame:
    """`carried` with proof_sha256 and folded_root, the root that `starts` (or, where null, the leaf) gives with the witness."""
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            k = len(carried)
            leaves, starts_, witnesses = (batch.column(i).to_pylist() for i in (k, k + 1, k + 2))
            found = [fold((s or x).encode(), w) for x, s, w in zip(leaves, starts_, witnesses, strict=True)]
            columns = [*batch.columns[:k], pa.array([p for _, p in found], pa.string()), pa.array([r.decode() for r, _ in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "proof_sha256", "folded_root"])

    given = rows.select(*carried, F.col("leaf").alias("__leaf"), F.col(starts).alias("__start"), "witness")
    return given.mapInArrow(run, f"{fields}, proof_sha256 string, folded_root string")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and witness of every document, and whether a leaf that was tampered with still gives the root."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    value = {f: F.col(f) for f in FIELDS}
    n = F.col("n_chars").cast("long")
    changed = value | {"n_chars": F.coalesce(F.try_add(n, F.lit(1)), n)}
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = F.when(hit & n.isNotNull(), leaf(list(changed.values())))
    # written once: sampling for the ranges must not read the texts again
    leaves = materialise(docs.select("doc_id", "lang", leaf(list(value.values())).alias("leaf"), tampered.alias("tampered")), "leaves")
    rows = proved(manifest(leaves, keep=("tampered",)), "tampered", ["doc_id", "leaf", "subroot", "root"])
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(n_chars: str) -> str:
    parts = (f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end" for c in ("doc_id", "source", "lang", n_chars, "text"))
    return f"sha256(concat({', '.join(parts)}))"


#: crc32 isn't a function of DuckDB: its table, and one step for each digit of an id, as SQL.
_CRC_TABLE = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC_TABLE[_i] = _c
_SQL_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ord(x) as bigint))), lambda c, b: xor(c >> 8, ({_CRC_TABLE})[(xor(c, b) & 255) + 1])), 4294967295)"
OP12_SQL = f"""
with recursive leaf as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, row_number() over () as r,
    case when doc_id is not null and n_chars is not null and {_SQL_CRC} % 7 = 0 then changed else leaf end as start
  from (select doc_id, lang, n_chars, {_sql_leaf("n_chars")} as leaf, {_sql_leaf("(n_chars + 1)")} as changed from documents)
), tree(lvl, lang, pos, h) as (
  select 0, lang, pos, leaf from leaf
  union all
  select lvl + 1, lang, pos // 2, sha256(string_agg(h, '' order by pos))
  from (select *, count(*) over (partition by lang) as n from tree) where n > 1 group by lvl, lang, pos // 2
), subroot as (
  select lang, lvl as height, h, row_number() over (order by lang nulls first) - 1 as pos from tree t
  where lvl = (select max(lvl) from tree x where x.lang is not distinct from t.lang)
), top(lvl, pos, h) as (
  select 0, pos, h from subroot
  union all
  select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over () as n from top) where n > 1 group by lvl, pos // 2
), root as (
  select lvl as height, h from top order by lvl desc limit 1
), step as (
  -- every level of every leaf's way, with the sibling if there is one
  select r, l.lvl, (l.pos >> l.lvl) & 1 as side, t.h as sibling
  from (select l.*, unnest(range(s.height)) as lvl from leaf l join subroot s on l.lang is not distinct from s.lang) l
  left join tree t on t.lang is not distinct from l.lang and t.lvl = l.lvl and t.pos = xor(l.pos >> l.lvl, 1)
  union all
  select r, s.height + s.lvl, (s.pos >> s.lvl) & 1, t.h
  from (select l.r, s.pos, s.height, unnest(range(root.height)) as lvl from leaf l join subroot s on l.lang is not distinct from s.lang, root) s
  left join top t on t.lvl = s.lvl and t.pos = xor(s.pos >> s.lvl, 1)
), folded(r, lvl, h) as (
  select r, cast(0 as bigint), start from leaf
  union all
  select f.r, f.lvl + 1, sha256(case when sibling is null then f.h when side = 1 then sibling || f.h else f.h || sibling end)
  from folded f join step s on s.r = f.r and s.lvl = f.lvl
), proof as (
  select r, sha256(coalesce(string_agg(sibling, '' order by lvl), '')) as proof_sha256 from leaf left join step using (r) group by r
), reached as (
  select r, arg_max(h, lvl) as folded_root from folded group by r
)
select doc_id, leaf, s.h as subroot, root.h as root, proof_sha256, folded_root, folded_root = root.h as verified
from leaf l join subroot s on l.lang is not distinct from s.lang join proof using (r) join reached using (r), root
"""


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The query's rows from (doc_id, source, lang, n_chars, text), level by level; for tests."""
    import zlib

    def h(*parts: str) -> str:
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf_of(values: tuple) -> str:
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def way(at: int, tree: list[list[str]]) -> list[tuple[int, str | None]]:
        return [((at >> k) & 1, nodes[(at >> k) ^ 1] if (at >> k) ^ 1 < len(nodes) else None) for k, nodes in enumerate(tree[:-1])]

    groups: dict = {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d))) for g in names}
    tree = {g: levels([leaf_of(d) for d in ordered[g]]) for g in names}
    top = levels([tree[g][-1][0] for g in names]) if names else []
    out = []
    for k, g in enumerate(names):
        for at, d in enumerate(ordered[g]):
            steps = way(at, tree[g]) + way(k, top)
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[3] is not None
            node = leaf_of((*d[:3], d[3] + 1, d[4])) if hit else leaf_of(d)
            for side, sibling in steps:
                node = h(node) if sibling is None else h(sibling, node) if side else h(node, sibling)
            out.append((d[0], leaf_of(d), tree[g][-1][0], top[-1][0], h(*(s for _, s in steps if s is not None)), node, node == top[-1][0]))
    return out
