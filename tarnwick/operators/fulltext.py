"""Keyword search by stems and positions, ranked by the density of covers.

A query has words, "phrases", OR and a minus that excludes, as in web search: what stands side by side must all be
met, OR parts alternatives. Words are compared by their stems, stop words are left out but keep their
place, so that phrases span them. A cover is a shortest stretch of a text that meets the query (exclusions aside); each
adds 0.1 / (1 + the words in it that the query doesn't ask for) to the rank.

Only words that can have one of the stems leave a text: they begin like it. The different ones among them are stemmed
once and joined back. Positions are joined within documents: a phrase's by its first position, and covers by windows over one
document's positions.

Defined cases: a null text matches nothing; a query of stop words, of exclusions alone or without words matches nothing;
alternatives that hold only exclusions are left out. Words are runs of letters and digits, without case.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.functions.stems import STOP_WORDS, stem, stems_of
from tarnwick.session import materialise

_TERM = re.compile(r'(-?)"([^"]*)"|(-?)(\S+)')
_WORD = r"[^\W_]+"

Term = tuple[tuple[str, int], ...]


def parsed(query: str) -> list[tuple[list[Term], list[Term]]]:
    """Alternatives, each with the terms it asks for and those it excludes; a term is stems with their distance from the first."""
    found: list[tuple[list[Term], list[Term]]] = [([], [])]
    for minus1, phrase, minus2, word in _TERM.findall(query):
        if word == "OR":
            found.append(([], []))
            continue
        words = re.findall(_WORD, (phrase or word).lower())
        kept = [(s, i) for i, (w, s) in enumerate(zip(words, stems_of(words), strict=True)) if w not in STOP_WORDS]
        if kept:
            found[-1][bool(minus1 or minus2)].append(tuple((s, i - kept[0][1]) for s, i in kept))
    return [(asked, barred) for asked, barred in found if asked]


def positions(docs: DataFrame, doc: str, text: str, stems: list[str]) -> DataFrame:
    """(doc, pos, stem): where the stems stand, by the number of the word from 1."""
    begins = sorted({re.escape(s[: max(1, len(s) - 2)]) for s in stems})
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"))
    placed = F.filter(F.transform(words, lambda w, i: F.struct((i + 1).alias("pos"), w.alias("word"))), lambda x: x["word"].rlike(f"^(?:{'|'.join(begins)})"))
    rows = docs.select(doc, F.explode(placed).alias("x")).select(doc, "x.pos", "x.word")
    different = rows.select("word").distinct().select("word", stem(F.col("word")).alias("stem")).filter(F.col("stem").isin(stems) & ~F.col("word").isin(*STOP_WORDS))
    return rows.join(different, "word").select(doc, "pos", "stem")


def _term(at: DataFrame, doc: str, term: Term) -> DataFrame:
    """(doc, begin, end): where a word or phrase stands; the words of a phrase meet by its first position."""
    parts = [at.filter(F.col("stem") == s).select(doc, (F.col("pos") - d).alias("begin")) for s, d in term]
    return reduce(lambda a, b: a.join(b, [doc, "begin"]), parts).select(doc, "begin", (F.col("begin") + term[-1][1]).alias("end"))


def search(docs: DataFrame, doc: str, text: str, query: str) -> DataFrame:
    """(doc, rank) of the documents that match, `doc` being unique."""
    spark, wanted = docs.sparkSession, parsed(query)
    if not wanted:
        return spark.createDataFrame([], f"`{doc}` {docs.schema[doc].dataType.simpleString()}, rank double")
    stems = sorted({s for asked, barred in wanted for term in (*asked, *barred) for s, _ in term})
    # written once: every term, the items and the covers read it
    at = materialise(positions(docs, doc, text, stems), "positions")
    own = Window.partitionBy(doc)
    asked_stems = sorted({s for asked, _ in wanted for term in asked for s, _ in term})
    # how many of the query's words stand before each position
    items = at.filter(F.col("stem").isin(asked_stems)).select(doc, "pos").distinct()
    items = items.withColumn("nth", F.row_number().over(own.orderBy("pos")))
    covers, matched = None, None
    for asked, barred in wanted:
        entries = [_term(at, doc, t).withColumn("term", F.lit(i)) for i, t in enumerate(asked)]
        rows = reduce(DataFrame.unionByName, entries)
        for t in barred:
            rows = rows.join(_term(at, doc, t).select(doc).distinct(), doc, "left_anti")
        before = own.orderBy("end").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        begins = [F.max(F.when(F.col("term") == i, F.col("begin"))).over(before) for i in range(len(asked))]
        start = reduce(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), begins)
        found = rows.select(doc, "end", start.alias("start")).filter("start is not null")
        covers = found if covers is None else covers.unionByName(found)
    covers = covers.groupBy(doc, "end").agg(F.max("start").alias("start"))
    # a stretch that holds an earlier one isn't shortest
    earlier = F.max("start").over(own.orderBy("end").rowsBetween(Window.unboundedPreceding, -1))
    covers = covers.withColumn("earlier", earlier).filter("earlier is null or start > earlier").drop("earlier")
    first = items.select(doc, F.col("pos").alias("start"), F.col("nth").alias("first"))
    last = items.select(doc, F.col("pos").alias("end"), F.col("nth").alias("last"))
    noise = F.expr("end - start - (last - first)")
    return covers.join(first, [doc, "start"]).join(last, [doc, "end"]).groupBy(doc).agg(F.sum(F.lit(0.1) / (1 + noise)).alias("rank"))
