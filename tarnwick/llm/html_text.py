"""Main text of web pages by differencing each page with the nearest page of its host.

A page is cut into lines, one for each block, menus and all. Pages of a host are ordered by
URL path; of the two pages before and the two behind, the one whose path agrees longest is the
partner. The longest common subsequence of both pages' lines is what the template gave them:
those shared lines are deleted. Two things keep copies of one article from deleting it: a shared
line must also stand in a second of the four neighbours, where the host has one (but for lines in
places marked as no main text), and a page never loses its last line.

Where a template can't be told from a quotation the page's own marks settle it:

* a line inside an <article>, <main> or a named content container goes as shared only if more
  than half of the host's pages hold it, for passages are quoted by neighbours;
* lines that are shared with nobody, such as a menu drawn anew for every page, go if they stand in a
  place marked as no main text (menus, footers, forms, adverts, comments ...), or outside
  the strongest content container of the page.

`main_text` reports for every page how many lines were deleted as shared and how many by their
marks alone.

Order comes from sorting narrow rows (host, path, line hashes) by range, so a host with a
third of all pages is spread over tasks; neighbours meet in groups of five on their rank. Only a
page's set of shared lines travels back to its text.

Defined cases: a null html is an empty text, a null url has no partner; equal pages (same
url and html) are one page to the order and keep their rows in the result; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.llm.batches import map_batches
from tarnwick.llm.html_lines import APART, CONTAINER, NEUTRAL, lines, longest_common
from tarnwick.session import materialise, table

#: Pages on either side among which the partner and the second witness are sought.
REACH = 2
#: Share of a host's pages that must hold a line inside their main text, and the fewest such pages, before it counts as the template's.
TEMPLATE, LEAST = 0.5, 10


def _chosen(found: list[tuple[int, str]], shared: set[int]) -> tuple[list[str], int]:
    """The lines that stay, and how many were deleted by their marks alone."""
    left = [x for i, x in enumerate(found) if i not in shared]
    strongest = max((p for p, _ in left if p != APART), default=NEUTRAL)
    stay = [t for p, t in left if p == strongest]
    return stay, len(left) - len(stay)


def _keyed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    return pages.withColumn("__key", F.xxhash64(url, html)).withColumn("__html", html).withColumn("__url", url)


def _outlines(pages: DataFrame) -> DataFrame:
    """(key, host, path, inside, hashes): the hashes of all lines, one row for each distinct page with an url.

    `inside` has a byte for each line: NEUTRAL, APART or CONTAINER, which stands for anything stronger too.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        inside, hashes = [], []
        for page in batch.column(3).to_pylist():
            found = lines(page)
            inside.append(bytes(min(p, CONTAINER) for p, _ in found))
            hashes.append([xxhash.xxh64_intdigest(t) - 2**63 for _, t in found])
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(inside, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], ["key", "host", "path", "inside", "hashes"])

    rest = F.regexp_extract("__url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", 0)
    host = F.lower(F.regexp_extract("__url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract("__url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    narrow = pages.filter(rest != "").select(F.col("__key").alias("key"), host.alias("host"), path.alias("path"), F.col("__html").alias("html"))
    return map_batches(narrow, run, "key long, host string, path string, inside binary, hashes array<long>").dropDuplicates(["key"])


def _ranked(outlines: DataFrame) -> DataFrame:
    """`outlines` with their rank by (host, path, key), which doesn't depend on how rows lie in partitions."""

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in it:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*batch.schema.names, "part", "at"])
            at += n

    order = ["host", "path", "key"]
    schema = "key long, host string, path string, inside binary, hashes array<long>, part int, at long"
    placed = materialise(outlines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "ranks")
    # one row for each partition: the rows before it
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at"))


def template_lines(host: str, page: dict, near: list[dict]) -> list[int]:
    """Places of the lines that a page shares with its nearest page and with one more; all but the last line at most."""
    others = [x for x in near if x["rank"] != page["rank"] and x["host"] == host and x["hashes"]]
    others.sort(key=lambda x: (-_agree(x["path"], page["path"]), abs(x["rank"] - page["rank"]), x["rank"]))
    if not others:
        return []
    common = longest_common(page["hashes"], others[0]["hashes"])
    if len(others) > 1:
        second = set().union(*(x["hashes"] for x in others[1:]))
        common = [i for i in common if page["inside"][i] == APART or page["hashes"][i] in second]
    return [] if len(common) == len(page["hashes"]) else common


def _shared(ranked: DataFrame) -> DataFrame:
    """(key, drop): places of a page's lines that differencing deletes; only pages that lose lines."""
    # ranks and hashes only; a page and its neighbours are one group of an equality key
    around = F.explode(F.sequence(F.col("rank") - REACH, F.col("rank") + REACH))
    copies = ranked.select(around.alias("of"), "rank", "key", "host", "path", "inside", "hashes")
    near = copies.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "host", "path", "inside", "hashes"))).alias("near"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows: list[tuple] = []
        for of, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = next((x for x in near if x["rank"] == of), None)
            if page is not None and (common := template_lines(page["host"], page, near)):
                sure = [i for i in common if page["inside"][i] < CONTAINER]
                asked = [i for i in common if page["inside"][i] == CONTAINER]
                rows.append((page["key"], page["host"], sure, asked, [page["hashes"][i] for i in asked]))
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        names = ["key", "host", "sure", "asked", "hashes"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names) if rows else None

    found = materialise(map_batches(near, run, "key long, host string, sure array<int>, asked array<int>, hashes array<long>"), "common")
    asked = found.select("key", "host", F.explode(F.arrays_zip("asked", "hashes")).alias("line")).select("key", "host", "line.asked", F.col("line.hashes").alias("line"))
    sizes = ranked.groupBy("host").agg(F.count("*").alias("pages"))
    held = ranked.select("host", F.explode(F.array_distinct("hashes")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    held = held.filter(F.col("n") >= LEAST).join(sizes, "host").filter(F.col("n") > TEMPLATE * F.col("pages")).select("host", "line")
    more = asked.join(held, ["host", "line"]).groupBy("key").agg(F.collect_list("asked").alias("more"))
    drop = F.concat("sure", F.coalesce("more", F.array().cast("array<int>")))
    return found.join(more, "key", "left").select("key", drop.alias("drop")).filter(F.size("drop") > 0)


def _agree(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_shared, n_marked) for each row of `pages`: blocks of the main text, one a line, and the lines deleted."""
    keyed = _keyed(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")), "url", "html")
    # a written table tells Spark its size
    shared = materialise(_shared(_ranked(_outlines(keyed))), "shared")
    rows = keyed.join(shared, keyed["__key"] == shared["key"], "left").select("page_id", "url", "html", "drop")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, differed, marked = [], [], []
        for page, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            stay, by_marks = _chosen(lines(page), set(drop or ()))
            out.append("\n".join(stay))
            differed.append(len(drop or ()))
            marked.append(by_marks)
        cols = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(differed, pa.int32()), pa.array(marked, pa.int32())]
        return pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_shared", "n_marked"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return map_batches(rows, run, f"page_id {kind}, url string, text string, n_shared int, n_marked int")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page from its whole html, with the lines that differencing and marks deleted."""
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_marked")


def brute_force(pages: list[tuple]) -> dict:
    """(url, html) -> text, the neighbours found in one sorted list and lines counted for the host; for tests."""
    rows = []
    for url, html in set(pages):
        parts = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)", url or "")
        if parts:
            rows.append([parts[1].lower(), parts[2], (url, html), lines(html)])
    out = {(url, html): _chosen(lines(html), set())[0] for url, html in pages}
    for host in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == host]
        assert len({r[1] for r in mine}) == len(mine), "paths decide the order"
        mine.sort(key=lambda r: r[1])
        count = Counter(t for r in mine for t in {t for _, t in r[3]})
        for i, (_, path, page, own) in enumerate(mine):
            others = [(j, mine[j]) for j in range(max(0, i - REACH), min(len(mine), i + REACH + 1)) if j != i and mine[j][3]]
            others.sort(key=lambda o: (-_agree(o[1][1], path), abs(o[0] - i), o[0]))
            if not others:
                continue
            text = [t for _, t in own]
            gone = longest_common(text, [t for _, t in others[0][1][3]])
            if len(others) > 1:
                gone = [k for k in gone if own[k][0] == APART or any(text[k] == t for _, o in others[1:] for _, t in o[3])]
            if len(gone) == len(text):
                gone = []
            gone = [k for k in gone if own[k][0] < CONTAINER or (count[text[k]] >= LEAST and count[text[k]] > TEMPLATE * len(mine))]
            out[page] = _chosen(own, set(gone))[0]
    return {k: "\n".join(v) for k, v in out.items()}
