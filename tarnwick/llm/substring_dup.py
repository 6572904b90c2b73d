"""Substring deduplication with a compressed FM-index per shard.

A window is `WINDOW` consecutive words. Of its runs of `ANCHOR` words the one of smallest
hash is its anchor, so equal windows have equal anchors; consecutive windows of one anchor
make a segment. Segments meet others of their anchor only, so an anchor's hash says which
shard they belong to, and a shard needs no text but theirs.

1. Segments are counted as (anchor, content hash, first document, number), combined in each
   batch before the shuffle. An anchor that occurs once holds no repetition. Hashes only name
   candidates; whatever is removed was found in an index over the words themselves.
2. Each different segment of a repeated anchor goes from its first document to the anchor's shard, and
   so do its copies in other documents. Where an anchor occurs more than `SALT` times, copies go to shards of
   their content hash instead, `SALT` documents to each, and the first occurrence to every one of these.
3. A shard is built into an FM-index (Burrows-Wheeler transform, wavelet matrix). Its segments
   stream through it by backward search; segments of equal words, compared byte by byte, share
   one search. The interval in which the search of a window ends holds all its matches; where the earliest of them
   stands before the window, it is reported.
4. Intervals go back to the documents, whose covered words are removed. Segments that a text repeats within itself
   are found by their hashes and compared word by word.

An anchor with more than `HOT` different segments (a phrase of a third of all documents in
ever new company) deals out single windows by their own hash instead. Anchors are counted by a
window over their segments; those in buckets of more than `ANCHOR_ROWS` rows in two steps of aggregation and a
join instead, so no task holds all segments of a common phrase.

Defined cases: ids are integers below 2**62; a null or empty text has no words; rows of null id come last,
in the order of a hash of their text; rows that share an id (or a null id and a text) are judged against
other ids and within themselves, and what they share with each other may stay; other columns are
ignored or pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarnwick.llm.batches import map_batches, plain_words, texts
from tarnwick.llm.fm_index import FMIndex, matching_statistics
from tarnwick.session import materialise, release, table

WINDOW = 20
ANCHOR = 5
#: Words in one index, and different segments from which an anchor counts as hot.
SHARD_WORDS = 1_000_000
HOT = 50_000
#: Documents of one content that a shard takes, and copies that it holds before it searches for them.
SALT, COPIES = 20_000, 200_000
#: Rows of one of BUCKETS ranges of anchors from which they are counted in two steps.
ANCHOR_ROWS, BUCKETS = 5_000_000, 1 << 20
SPAN = WINDOW - ANCHOR + 1
#: Bytes of text worked on at a time.
GROUP = 1 << 20
_NULLS = 2**62
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_C = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_B, _BINV)):
            _powers[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, base)]))
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


class Segments:
    """Segments of many texts at once, as arrays: text (its number), anchor, content, start (first word within the text), windows.

    Words are never made into objects: their hashes are differences of running sums over the
    bytes, and the hashes of runs of words differences of running sums over those.
    """

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        blank = _BLANK[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate([[0], edge])
        begin, end = edge[::2], edge[1::2]
        power, inverse = _power_tables(len(data) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * power[: len(data)])])
        w = _mix(_mix((sums[end] - sums[begin]) * inverse[begin]) + (end - begin).astype(np.uint64))
        sizes = np.array([len(t) + 1 for t in texts])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        #: Where each text's words begin among all words, and one more for their number.
        self.first_word = np.searchsorted(begin, offsets)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(w * power[: len(w)])])
        self.inverse = inverse
        n = len(w)
        words_of = np.diff(self.first_word)
        behind = np.repeat(self.first_word[1:], words_of)
        place = np.flatnonzero(np.arange(n) + WINDOW <= behind)
        if not len(place):
            self.text = self.start = self.windows = self.begin = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.int64)
            return
        grams = _mix((self.sums[ANCHOR:] - self.sums[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
        # the smallest of the runs in each window, by doubling
        span, smallest, have = SPAN, grams, 1
        while have * 2 <= span:
            smallest, have = np.minimum(smallest[:-have], smallest[have:]), have * 2
        if have < span:
            smallest = np.minimum(smallest[: have - span], smallest[span - have :])
        smallest = smallest[place]
        of = np.repeat(np.arange(len(texts)), words_of)[place]
        new = np.concatenate([[True], (smallest[1:] != smallest[:-1]) | (of[1:] != of[:-1])])
        run = np.flatnonzero(new)
        # a text that repeats one word keeps its anchor for long: such runs are cut
        at = np.flatnonzero((np.arange(len(place)) - run[np.cumsum(new) - 1]) % span == 0)
        self.windows = np.diff(np.concatenate([at, [len(place)]]))
        self.text, self.begin, self.anchor = of[at], place[at], smallest[at].view(np.int64)
        self.start = self.begin - self.first_word[self.text]
        self.content = self._hashes(self.begin, self.begin + self.windows + WINDOW - 1)

    def _hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix(_mix((self.sums[end] - self.sums[begin]) * self.inverse[begin]) + (end - begin).astype(np.uint64)).view(np.int64)

    def window_hashes(self, i: int) -> np.ndarray:
        at = self.begin[i] + np.arange(self.windows[i])
        return self._hashes(at, at + WINDOW)

    def again(self) -> np.ndarray:
        """Whether a window stands twice in the segment."""
        out = np.zeros(len(self.text), bool)
        if not len(out):
            return out
        of = np.repeat(np.arange(len(out)), self.windows)
        at = self.begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        whole = self._hashes(at, at + WINDOW)
        for d in range(1, SPAN):
            if len(of) <= d:
                break
            equal = (whole[d:] == whole[:-d]) & (of[d:] == of[:-d])
            out[of[:-d][equal]] = True
        return out

    def firsts(self) -> np.ndarray:
        """Numbers of the segments whose content stands nowhere before in their text."""
        order = np.lexsort((self.content, self.text))
        c, t = self.content[order], self.text[order]
        return np.sort(order[np.concatenate([[True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])])]) if len(order) else order


def _groups(texts: list[bytes]) -> Iterator[range]:
    """Ranges of texts of about GROUP bytes."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > GROUP:
            yield range(at, i)
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield range(at, len(texts))


def _order(id_col: str, text_col: str) -> Column:
    """The number by which documents are ordered; rows of null id stand behind all others."""
    last = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).bitwiseAND(F.lit(_NULLS - 1)).bitwiseOR(F.lit(_NULLS))
    return F.coalesce(F.col(id_col).cast("long"), last)


def _batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names)


def _occurrences(docs: DataFrame, combine: bool) -> DataFrame:
    """(anchor, content, doc, n) of each text's different segments; combined, doc is the smallest of the batch and n counts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts, ids, all_texts = [], batch.column(0).to_numpy(), texts(batch, "text")
        for group in _groups(all_texts):
            s = Segments(all_texts[group.start : group.stop])
            first = s.firsts()
            n = 1 + s.again()[first].astype(np.int64) if combine else np.ones(len(first), np.int64)
            parts.append((s.anchor[first], s.content[first], ids[group.start + s.text[first]], n))
        if not parts:
            return None
        anchor, content, doc, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        if combine:
            order = np.lexsort((doc, content, anchor))
            anchor, content, doc, n = anchor[order], content[order], doc[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]))
            anchor, content, doc, n = anchor[at], content[at], doc[at], np.add.reduceat(n, at)
        return _batch(["anchor", "content", "doc", "n"], [anchor, content, doc, n])

    return map_batches(docs, run, "anchor long, content long, doc long, n long")


def _repeated(docs: DataFrame) -> DataFrame:
    """(anchor, content, first, n, kinds, total) for each segment of an anchor that occurs more than once."""
    found = materialise(_occurrences(docs, combine=True), "occurrences")
    bucket = F.pmod("anchor", F.lit(BUCKETS))
    hot = [r.bucket for r in found.groupBy(bucket.alias("bucket")).count().filter(F.col("count") > ANCHOR_ROWS).collect()]
    segment = (F.min("doc").alias("first"), F.sum("n").alias("n"))
    over = Window.partitionBy("anchor")
    small = (found.filter(~bucket.isin(hot)) if hot else found).repartition("anchor").groupBy("anchor", "content").agg(*segment)
    out = small.withColumn("kinds", F.count("*").over(over)).withColumn("total", F.sum("n").over(over)).filter("total > 1")
    if hot:
        large = materialise(found.filter(bucket.isin(hot)).groupBy("anchor", "content").agg(*segment), "common")
        kinds = large.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).filter("total > 1")
        out = out.unionByName(large.join(kinds, "anchor"))
    segments = materialise(out, "segments")
    release(found)
    return segments


#: What a document is asked for: a segment for its anchor's shard, its windows one by one, a content's first occurrence, a later one.
ANCHORED, WINDOWS, FIRST, COPY = 0, 1, 2, 3


def _asked(docs: DataFrame) -> DataFrame:
    """(__of, __asked): the segments that each document is asked for, as (content, how, shards of that content)."""
    segments = _repeated(docs)
    apart = (F.col("total") > SALT) | (F.col("kinds") > HOT)
    how = F.when(F.col("kinds") > HOT, WINDOWS).otherwise(ANCHORED)
    own = segments.filter((F.col("kinds") > 1) & ((F.col("n") == 1) | apart)).select(F.col("first").alias("__of"), "content", how.alias("how"), F.lit(0).alias("shards"))
    several = segments.filter("n > 1").select("anchor", "content", "first", F.when(apart, F.ceil(F.col("n") / SALT)).otherwise(0).cast("int").alias("shards"))
    of = _occurrences(docs, combine=False).join(several, ["anchor", "content"])
    how = F.when(F.col("shards") == 0, ANCHORED).when(F.col("doc") == F.col("first"), FIRST).otherwise(COPY)
    copies = of.select(F.col("doc").alias("__of"), "content", how.alias("how"), "shards")
    return own.unionByName(copies).groupBy("__of").agg(F.collect_list(F.struct("content", "how", "shards")).alias("__asked"))


class _Shard:
    """Segments of a run of keys, and the copies of each that stand behind it."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, bytes]] = []  # document, start, content, offset, words
        self.copies: list[tuple[int, int, int, int]] = []  # row, document, content, offset
        self.size = 0

    def search(self) -> pa.RecordBatch | None:
        """(doc, content, mask) of what stands earlier."""
        order = sorted(range(len(self.rows)), key=lambda i: self.rows[i][:2])
        symbols: dict[bytes, int] = {}
        text, starts, windows = [], [], []
        place = np.empty(len(order), np.int64)
        for i in order:
            if starts and self.rows[i][:2] == self.rows[before][:2]:  # the same occurrence under two keys
                place[i] = place[before]
                continue
            before, place[i] = i, len(starts)
            words = self.rows[i][4].split(b" ")
            starts.append(len(text))
            windows.append(len(words) - WINDOW + 1)
            text += [symbols.setdefault(w, len(symbols) + 1) for w in words]
            text.append(0)
        t, s, w = np.array(text), np.array(starts), np.array(windows)
        # rows lie in the order of (document, start), so an earlier match is one at a smaller position
        at, matches, earlier = matching_statistics(FMIndex(t, len(symbols) + 1, WINDOW), t, s, w, WINDOW)
        of = np.searchsorted(s, at, side="right") - 1
        bit = np.int64(1) << (at - s[of])
        met, later = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        np.bitwise_or.at(met, of[matches > 0], bit[matches > 0])
        np.bitwise_or.at(later, of[earlier], bit[earlier])
        doc, _, content, offset, _ = zip(*self.rows, strict=True)
        parts = [(np.array(doc), np.array(content), later[place] << np.array(offset))]
        if self.copies:  # the search of a segment is that of its copies; each match is earlier than they are
            row, doc, content, offset = (np.array(x, np.int64) for x in zip(*self.copies, strict=True))
            parts.append((doc, content, met[place[row]] << offset))
        doc, content, mask = (np.concatenate(x) for x in zip(*parts, strict=True))
        hit = mask != 0
        return _batch(["doc", "content", "mask"], [doc[hit], content[hit], mask[hit]]) if hit.any() else None


def _indexed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Searches rows sorted by (copied, key, doc, start) shard by shard; yields what is repeated as (doc, content, mask).

    A shard holds either contents with their copies or segments by anchor, so no occurrence meets itself.
    """
    shard, last = _Shard(), (None, None)
    known: dict[bytes, int] = {}  # rows of the key at hand by their words
    for batch in it:
        for copied, key, doc, start, content, offset, words in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if (copied, key) != last:
                if shard.rows and (shard.size >= SHARD_WORDS or copied != last[0]):
                    if out := shard.search():
                        yield out
                    shard = _Shard()
                known, last = {}, (copied, key)
            if (row := known.get(words)) is not None:
                shard.copies.append((row, doc, content, offset))
                if len(shard.copies) >= COPIES:  # the key may go on: its rows stay in the next shard
                    if out := shard.search():
                        yield out
                    left = [shard.rows[i] for i in known.values()]
                    shard, known = _Shard(), {r[4]: i for i, r in enumerate(left)}
                    shard.rows, shard.size = left, sum(r[4].count(b" ") + 2 for r in left)
                continue
            known[words] = len(shard.rows)
            shard.rows.append((doc, start, content, offset, words))
            shard.size += words.count(b" ") + 2
    if shard.rows and (out := shard.search()):
        yield out


def _contents(with_lists: DataFrame, text_col: str) -> DataFrame:
    """(copied, key, doc, start, content, offset, words) of the segments each document is asked for; key says where they meet others.

    `with_lists` has columns __of, __asked and the text.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows: list[tuple] = []
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
        ids, all_texts, asked = column("__of"), texts(batch, text_col), column("__asked")
        for group in _groups(all_texts):
            s = Segments(all_texts[group.start : group.stop])
            first, at = s.firsts(), -1
            wanted: dict[int, list[tuple[int, int]]] = {}
            for i, k, content, start, count, anchor in zip(first.tolist(), *(x[first].tolist() for x in (s.text, s.content, s.start, s.windows, s.anchor)), strict=True):
                if k != at:
                    at, wanted = k, {}
                    for x in asked[group.start + k]:
                        wanted.setdefault(x["content"], []).append((x["how"], x["shards"]))
                    words = plain_words(all_texts[group.start + k])
                for how, shards in wanted.get(content, ()):
                    doc = ids[group.start + k]
                    if how == WINDOWS:
                        rows += [(False, h, doc, start + o, content, o, b" ".join(words[start + o : start + o + WINDOW])) for o, h in enumerate(s.window_hashes(i).tolist())]
                        continue
                    # a third of all documents may share a content: they go to several shards, and the first to each of these
                    keys = [anchor] if how == ANCHORED else range(shards) if how == FIRST else [xxhash.xxh32_intdigest(b"%d" % doc) % shards]
                    joined = b" ".join(words[start : start + count + WINDOW - 1])
                    rows += [(how != ANCHORED, k if how == ANCHORED else _signed(content + k * 0x9E3779B97F4A7C15), doc, start, content, 0, joined) for k in keys]
        if not rows:
            return None
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return _batch(["copied", "key", "doc", "start", "content", "offset", "words"], [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)])

    return map_batches(with_lists, run, "copied boolean, key long, doc long, start int, content long, offset int, words binary")


def _signed(x: int) -> int:
    """The low 64 bits as a signed number."""
    return ((x + 2**63) & (2**64 - 1)) - 2**63


def _with_cuts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with a column __cuts: the segments that lose words (content hash) and the windows of each as a mask.

    Texts are dealt out by document once; both joins, for the contents and for the cuts, read that one exchange,
    which is why both take all columns.
    """
    order = _order(id_col, text_col)
    dealt = docs.withColumn("__of", order).repartition("__of")
    asked = _asked(docs.select(order.alias("doc"), F.col(text_col).cast("string").alias("text")))
    contents = _contents(dealt.join(asked, "__of"), text_col)
    matched = contents.repartition("key").sortWithinPartitions("copied", "key", "doc", "start").mapInArrow(_indexed, "doc long, content long, mask long")
    cuts = matched.groupBy(F.col("doc").alias("__of")).agg(F.collect_list(F.struct("content", "mask")).alias("__cuts"))
    return dealt.join(cuts, "__of", "left").drop("__of")


def removed_words(all_texts: list[bytes], cuts: list[list[dict] | None]) -> list[np.ndarray | None]:
    """For each text which of its words are covered by a repeated window; None if it holds no repetition at all.

    A segment whose words, compared one by one, stand earlier in the same text goes whole, reported or not.
    """
    out: list[np.ndarray | None] = []
    for group in _groups(all_texts):
        part = all_texts[group.start : group.stop]
        s = Segments(part)
        first = np.zeros(len(s.text), bool)
        first[s.firsts()] = True
        edges = [None] * len(part)
        at, masks, begins, words = -1, {}, {}, []
        for k, content, start, windows, new in zip(*(x.tolist() for x in (s.text, s.content, s.start, s.windows, first)), strict=True):
            if k != at:
                at, masks, begins, words = k, {}, {}, []
                for x in cuts[group.start + k] or ():
                    masks[x["content"]] = masks.get(x["content"], 0) | x["mask"]
            mask = masks.get(content, 0) if new else -1
            if new:
                begins[content] = start
            else:
                words = words or plain_words(part[k])
                size, first_at = windows + WINDOW - 1, begins[content]
                if words[start : start + size] != words[first_at : first_at + size]:
                    continue
            if not mask:
                continue
            if edges[k] is None:
                edges[k] = np.zeros(s.first_word[k + 1] - s.first_word[k] + 1, np.int64)
            edge = edges[k]
            if mask == -1:  # stands earlier in the same text
                edge[start] += 1
                edge[start + windows + WINDOW - 1] -= 1
            else:
                for o in range(windows):
                    if mask >> o & 1:
                        edge[start + o] += 1
                        edge[start + o + WINDOW] -= 1
        out += [None if e is None else np.cumsum(e[:-1]) > 0 for e in edges]
    return out


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without repeated passages: white space between words that stay is kept, a text left without words is dropped."""
    fields = docs.schema.fields

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, stay, out = batch.schema.get_field_index(text_col), [], []
        cuts = batch.column(batch.schema.get_field_index("__cuts")).to_pylist()
        all_texts = texts(batch, text_col)
        for old, text, gone in zip(batch.column(at).to_pylist(), all_texts, removed_words(all_texts, cuts), strict=True):
            out.append(old if gone is None else _cut_out(text, plain_words(text), gone).decode(errors="replace"))
            stay.append(gone is None or not gone.all())
        columns = [pa.array(out, pa.string()) if f.name == text_col else batch.column(batch.schema.get_field_index(f.name)) for f in fields]
        return pa.RecordBatch.from_arrays(columns, [f.name for f in fields]).filter(pa.array(stay))

    kept = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in fields])
    return map_batches(_with_cuts(docs, id_col, text_col), run, kept)


def _cut_out(text: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    out, at = [], 0
    for word, away in zip(words, gone.tolist(), strict=True):
        begin = text.index(word, at)
        out.append(b"" if away else text[at : begin + len(word)])
        at = begin + len(word)
    return b"".join(out).strip() + (b"" if gone[-1] else text[at:])


def op8_substring_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every whole document when words in repeated windows of twenty are removed."""
    docs = _with_cuts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, removed, digests = [], [], []
        all_texts = texts(batch, "text")
        for text, gone in zip(all_texts, removed_words(all_texts, batch.column(2).to_pylist()), strict=True):
            words = plain_words(text)
            total.append(len(words))
            removed.append(0 if gone is None else int(gone.sum()))
            kept = words if gone is None else [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return _batch(["doc_id", "n_words", "n_removed", "kept_sha256"], [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())])

    return map_batches(docs.select("doc_id", "text", "__cuts"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def brute_force(docs: list[tuple]) -> dict:
    """doc_id -> (words, removed, digest) by a table of all windows; for tests."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - WINDOW + 1):
            window = tuple(words[i : i + WINDOW])
            if window in seen:
                gone |= set(range(i, i + WINDOW))
            seen.add(window)
        out[doc] = (len(words), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())
    return out


OP8_SQL = f"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), win as (
  select r, doc_id, p, array_to_string(w[p + 1:p + {WINDOW}], ' ') as t
  from (select *, unnest(range(len(w) - {WINDOW - 1})) as p from d where len(w) >= {WINDOW})
), dup as (
  select r, p from (select r, p, row_number() over (partition by t order by doc_id nulls last, p) as k from win) where k > 1
), gone as (
  select distinct r, unnest(range(p, p + {WINDOW})) as i from dup
), word as (
  select r, unnest(w) as word, unnest(range(len(w))) as i from d
), kept as (
  select word.r, string_agg(word, ' ' order by i) as t, count(*) as n from word anti join gone using (r, i) group by 1
)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r)
"""
