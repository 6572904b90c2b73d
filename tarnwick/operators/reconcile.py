"""Reconciling what the chunks of one document name: people, organizations, and anything with a fingerprint.

Chunks overlap, so a chunk speaks only for what begins in the range that it owns. A document's
candidates are folded in the order of their evidence, since what a short form stands for depends on what
was named before it. The fold is an `aggregate` over the sorted array of one document's candidates: the
documents are grouped once, and a task holds one document's names at a time.

Defined cases: a null or blank name, a candidate without evidence and one that its chunk doesn't own
take no part; candidates of equal start keep the order of their names; a document whose candidates all stay
unresolved has one row without a cluster; null documents are a document of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import text as t

_PERSON = "struct<name:string,given:string,family:string,key:string,n:int,starts:array<bigint>,mentions:array<string>>"
_ORGANIZATION = "struct<name:string,norm:string,key:string,acronym:string,short:boolean,starts:array<bigint>,mentions:array<string>>"

# who a candidate c may be among the clusters k: one name, or one family name without a given name that speaks against it
_SAME_PERSON = (
    "coalesce(k.key = c.key, false) or (coalesce(k.family = c.family, false) and"
    " (k.given is null or c.given is null or k.given = c.given or (least(length(k.given), length(c.given)) = 1 and left(k.given, 1) = left(c.given, 1))))"
)
_SAME_ORGANIZATION = "k.key = c.key or coalesce(k.acronym = c.norm, false) or coalesce(c.acronym = k.norm, false)"


def owned(start: str | Column, owned_from: str | Column, owned_to: str | Column) -> Column:
    """Whether evidence begins in the range that its chunk owns."""
    start = F.col(start) if isinstance(start, str) else start
    return F.coalesce((start >= owned_from) & (start < owned_to), F.lit(False))


def _folded(candidates: DataFrame, doc: str, kind: str, same: str, unnamed: str, better: str, fields: list[str]) -> DataFrame:
    """(doc, cluster, name, starts, mentions, unresolved): the fold of each document's candidates c into clusters k.

    One cluster that may be the same takes a candidate in, with the candidate's fields where `better`; a candidate that is `unnamed`,
    given the matches h, is counted as unresolved; any other is a cluster of its own.
    """
    own = "named_struct(" + ", ".join(f"'{f}', c.{f}" for f in fields) + ", 'starts', array(c.start), 'mentions', array(c.mention))"
    both = "named_struct(" + ", ".join(f"'{f}', if({better}, c.{f}, k.{f})" for f in fields) + ", 'starts', concat(k.starts, array(c.start)), 'mentions', array_union(k.mentions, array(c.mention)))"
    step = (
        "case when size(h) = 1 then named_struct('clusters', transform(s.clusters, (k, i) -> if(i = h[0], " + both + ", k)), 'unresolved', s.unresolved)"
        f" when {unnamed} then named_struct('clusters', s.clusters, 'unresolved', s.unresolved + 1)"
        f" else named_struct('clusters', concat(s.clusters, array({own})), 'unresolved', s.unresolved) end"
    )
    # the matches are formed once for each candidate and named h
    hits = f"filter(transform(s.clusters, (k, i) -> if({same}, i, -1)), i -> i >= 0)"
    fold = f"aggregate(candidates, named_struct('clusters', cast(array() as array<{kind}>), 'unresolved', 0), (s, c) -> transform(array({hits}), h -> {step})[0])"
    sorted_ = candidates.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", *fields, "mention"))).alias("candidates"))
    folded = sorted_.select(doc, F.expr(fold).alias("state"))
    rows = folded.select(doc, F.posexplode_outer("state.clusters").alias("cluster", "found"), F.col("state.unresolved").alias("unresolved"))
    return rows.select(doc, "cluster", F.col("found.name").alias("name"), F.col("found.starts").alias("starts"), F.col("found.mentions").alias("mentions"), "unresolved")


def _taking_part(candidates: DataFrame, name: str, start: str, own: Column | None, mention: str | None) -> DataFrame:
    kept = candidates.filter(F.col(start).isNotNull() & (F.trim(F.coalesce(F.col(name), F.lit(""))) != ""))
    kept = kept if own is None else kept.filter(own)
    return kept.withColumn("__mention", F.trim(F.col(mention or name))).withColumn("__start", F.col(start).cast("long")).withColumn("__name", F.trim(F.col(name)))


def people(candidates: DataFrame, doc: str, name: str, start: str, *, own: Column | None = None, mention: str | None = None) -> DataFrame:
    """(doc, cluster, name, starts, mentions, unresolved): the people of each document in order of their first evidence.

    A name joins the one cluster of an equal name, or of an equal family name and a given name that agrees; a surname alone joins the
    one fuller name that has it, and stays unresolved where there is none, or more than one. The fullest name stands for a cluster.
    """
    rows = _taking_part(candidates, name, start, own, mention)
    key, parts = t.fold_key("__name"), t.name_parts(t.fold_key("__name"))
    n = F.size(F.split(key, " "))
    fields = [F.col("__name").alias("name"), parts["given"].alias("given"), parts["family"].alias("family"), key.alias("key"), n.alias("n")]
    rows = rows.select(doc, F.col("__start").alias("start"), *fields, F.col("__mention").alias("mention"))
    return _folded(rows, doc, _PERSON, _SAME_PERSON, r"c.n = 1 and c.key rlike '^\\p{L}{2,}$'", "c.n > k.n", ["name", "given", "family", "key", "n"])


def organizations(candidates: DataFrame, doc: str, name: str, start: str, *, own: Column | None = None, mention: str | None = None) -> DataFrame:
    """(doc, cluster, name, starts, mentions, unresolved): the organizations of each document in order of their first evidence.

    A name joins the one cluster of an equal name, or the one whose initials it is; one word of two to six letters
    that is nobody's initials so far, or of several, stays unresolved. The written-out name stands for a cluster, else the longer.
    """
    rows = _taking_part(candidates, name, start, own, mention)
    norm = t.normalize_text("__name")
    short = norm.rlike(r"^\p{L}{2,6}$")
    fields = [F.col("__name").alias("name"), norm.alias("norm"), t.fold_key("__name").alias("key"), F.when(F.contains(norm, F.lit(" ")), F.lower(t.acronym("__name"))).alias("acronym"), short.alias("short")]
    rows = rows.select(doc, F.col("__start").alias("start"), *fields, F.col("__mention").alias("mention"))
    better = "(k.short and not c.short) or (k.short = c.short and length(c.norm) > length(k.norm))"
    return _folded(rows, doc, _ORGANIZATION, _SAME_ORGANIZATION, "c.short", better, ["name", "norm", "key", "acronym", "short"])


def by_fingerprint(candidates: DataFrame, doc: str, fingerprint: Column, start: str, keep: list[str], *, own: Column | None = None) -> DataFrame:
    """(doc, *keep, seen): places and records, one for each fingerprint of a document, as the earliest evidence has them."""
    kept = candidates.filter(F.col(start).isNotNull() if own is None else own)
    first = F.min_by(F.struct(*keep), F.struct(F.col(start), F.struct(*keep)))
    return kept.groupBy(doc, fingerprint.alias("__print")).agg(first.alias("__first"), F.count("*").alias("seen")).select(doc, "__first.*", "seen")
