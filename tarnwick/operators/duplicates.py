"""Near duplicates of organizations and people: keys, pairs within keys, signals, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import text
from tarnwick.operators import catalog
from tarnwick.operators.graph import components
from tarnwick.operators.runs import ordinals

ORGANIZATION_SCORE, PERSON_SCORE, HELD_DOWN = 0.84, 0.88, 0.83
# Words that tell organizations apart no better than chance.
GENERIC = ("the", "of", "and", "for", "inc", "llc", "co", "company", "corp", "corporation", "association", "department", "city", "county", "school", "district", "club", "team", "center")


def organization_keys(label: str) -> Column:
    """Keys under which two labels may meet: the same text, the same tokens in any order, first and last, last, acronym."""
    toks = F.filter(F.split(text.fold_key(label), "[^a-z0-9]+"), lambda t: t != "")
    own = F.filter(toks, lambda t: ~t.isin(*GENERIC))
    first, last = F.try_element_at(own, F.lit(1)), F.try_element_at(own, F.lit(-1))
    keys = [
        F.concat(F.lit("exact:"), text.fold_key(label)),
        F.concat(F.lit("variant:"), F.array_join(F.array_sort(F.array_distinct(own)), " ")),
        F.when(F.size(own) > 1, F.concat(F.lit("first-last:"), first, F.lit(" "), last)),
        F.when(F.size(own) > 1, F.concat(F.lit("last:"), last)),
        F.concat(F.lit("acronym:"), F.when(F.size(own) == 1, F.upper(own[0])).otherwise(text.acronym(label))),
    ]
    return F.filter(F.array_distinct(F.array(*keys)), lambda k: k.isNotNull() & ~k.isin("exact:", "variant:"))


def person_keys(label: str) -> Column:
    """The same text, the same tokens, given and family name; labels of groups only the first two."""
    parts = text.name_parts(label)
    group = F.lower(label).rlike(r"\b(family|brothers|sisters|band|group)\b")
    keys = [
        F.concat(F.lit("exact:"), text.fold_key(label)),
        F.concat(F.lit("variant:"), F.array_join(text.tokens(text.fold_key(label)), " ")),
        F.when(~group & parts["given"].isNotNull(), F.concat(F.lit("first-last:"), F.substring(parts["given"], 1, 1), F.lit(" "), parts["family"])),
    ]
    return F.filter(F.array_distinct(F.array(*keys)), lambda k: k.isNotNull())


def _signals(a: str, b: str, generic: bool) -> tuple[Column, Column]:
    """(score, distinctive tokens shared)."""
    x, y = text.fold_key(a), text.fold_key(b)
    tx, ty = text.tokens(x), text.tokens(y)
    own = lambda t: F.filter(t, lambda w: ~w.isin(*GENERIC)) if generic else t
    shared = F.size(F.array_intersect(own(tx), own(ty)))
    same = x == y
    variant = F.array_join(F.array_sort(own(tx)), " ") == F.array_join(F.array_sort(own(ty)), " ")
    close = F.greatest(F.when(variant & (F.size(own(tx)) > 0), 0.95).otherwise(0.0), text.jaccard(own(tx), own(ty)), text.trigram_similarity(x, y))
    # only equal labels are certain
    return F.when(same, 1.0).otherwise(F.least(close, F.lit(0.95))), shared


def _numbers(label: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(label), F.lit(r"(\d+)"), F.lit(1))))


def organization_pairs(entities: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """(a, b, score) of (id, label) rows that score 0.84 or more: pairs between representatives, and each row of an equal label
    with its representative, the smallest id.

    Fewer than two distinctive tokens in common, or different numbers, hold a pair that isn't equal below the cut.
    """
    e = _represented(entities, dismissed)
    rows = _candidates(e, organization_keys("label"), True, ORGANIZATION_SCORE)
    score, shared = _signals("la", "lb", True)
    equal = text.fold_key("la") == text.fold_key("lb")
    held = ~equal & ((shared < 2) | (_numbers("la") != _numbers("lb")))
    scored = rows.withColumn("score", F.when(held, F.least(score, F.lit(HELD_DOWN))).otherwise(score))
    return scored.filter(F.col("score") >= ORGANIZATION_SCORE).select("a", "b", "score").unionByName(_copies(e))


def person_pairs(entities: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """(a, b, score) of (id, label) rows that score 0.88 or more, with representatives as in `organization_pairs`;
    different suffixes hold a pair below the cut."""
    e = _represented(entities, dismissed)
    rows = _candidates(e, person_keys("label"), False, PERSON_SCORE)
    score, _ = _signals("la", "lb", False)
    suffix = lambda c: F.regexp_extract(F.lower(c), r"\b(jr|sr|ii|iii|iv|v)\.?$", 1)
    scored = rows.withColumn("score", F.when(suffix("la") != suffix("lb"), F.least(score, F.lit(HELD_DOWN))).otherwise(score))
    return scored.filter(F.col("score") >= PERSON_SCORE).select("a", "b", "score").unionByName(_copies(e))


def _represented(entities: DataFrame, dismissed: DataFrame | None) -> DataFrame:
    """(id, label, rep): rows of an equal folded label have the smallest id as representative; a row of a dismissed pair
    (`dismissed`: pair_key) represents itself, so that what is dismissed is never said by a copy."""
    e = entities.select("id", "label", text.fold_key("label").alias("norm")).filter("id is not null and label is not null")
    if dismissed is not None:
        named = dismissed.select(F.explode(F.split("pair_key", r"\|")).alias("name")).distinct().withColumn("__own", F.lit(True))
        e = e.join(named, F.col("id").cast("string") == F.col("name"), "left").withColumn("own", F.when(F.col("__own"), F.col("id"))).drop("name", "__own")
    else:
        e = e.withColumn("own", F.lit(None).cast(entities.schema["id"].dataType))
    # minima are combined before the shuffle, and the join back is one that Spark can split
    least = e.groupBy("norm", "own").agg(F.min("id").alias("rep"))
    same = (F.col("e.norm") == F.col("l.norm")) & F.col("e.own").eqNullSafe(F.col("l.own"))
    return e.alias("e").join(least.alias("l"), same).select("e.id", "e.label", "l.rep")


def _copies(represented: DataFrame) -> DataFrame:
    return represented.filter("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))


def _candidates(represented: DataFrame, keys: Column, generic: bool, floor: float) -> DataFrame:
    """(a, b, la, lb) of representatives that share a key and may reach `floor`.

    A score above it needs that share of tokens or of trigrams in common, so both have one of their n - ceil(floor n) + 1 rarest
    (within the key) in common: rows meet by key and such an element, and no key is too frequent to be used.
    """
    tokens_ = text.tokens(text.fold_key("label"))
    own = F.filter(tokens_, lambda w: ~w.isin(*GENERIC)) if generic else tokens_
    sets = F.array(F.struct(F.lit("t").alias("kind"), own.alias("set")), F.struct(F.lit("g").alias("kind"), text.trigrams(text.fold_key("label")).alias("set")))
    r = represented.filter("id = rep").select("id", "label", F.explode(keys).alias("key"))
    # a key of one representative, as most are, joins nothing: it goes before its sets are made
    r = r.join(r.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key", "left_semi")
    r = r.select("id", "key", F.inline(sets)).withColumn("set", F.when(F.size("set") == 0, F.array(F.lit(""))).otherwise(F.col("set")))
    each = r.select("id", "key", "kind", F.explode("set").alias("x"))
    ranked = each.join(each.groupBy("key", "kind", "x").agg(F.count("*").alias("df")), ["key", "kind", "x"])
    ranked = ranked.groupBy("id", "key", "kind").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("order"))
    rare = F.expr(f"slice(order, 1, cast(size(order) - ceil({floor} * size(order)) + 1 as int)).x")
    met = ranked.select("id", "key", "kind", F.explode(rare).alias("x"))
    pairs = met.alias("m").join(met.alias("n"), ["key", "kind", "x"]).filter("m.id < n.id").select(F.col("m.id").alias("a"), F.col("n.id").alias("b")).distinct()
    return _with_labels(pairs, represented)


def _with_labels(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    a = entities.select(F.col("id").alias("a"), F.col("label").alias("la"))
    b = entities.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    return pairs.join(a, "a").join(b, "b")


def clusters(pairs: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """(cluster, size, members): groups of two or more that pairs join, dismissed pairs left out first; ids joined by commas in order."""
    kept = pairs if dismissed is None else catalog.without_dismissed(pairs, dismissed)
    found = components(kept).groupBy(F.col("root").alias("cluster"))
    return found.agg(F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), ",").alias("members"))


def ordered(found: DataFrame, members: DataFrame) -> DataFrame:
    """`found` (cluster, size) in the order of a review list, as `ordinal`: equal labels first, then the larger, then by label and first id.

    `members`: cluster, id, label. The label of a cluster of equal ones is that, else its first row's.
    """
    norm = text.normalize_text("label")
    m = members.filter("label is not null").groupBy("cluster").agg(F.count_distinct(norm).alias("labels"), F.min(norm).alias("least"), F.min_by(norm, "id").alias("own"), F.min("id").alias("first"))
    rows = found.join(m, "cluster", "left").withColumn("exact", F.coalesce(F.col("labels") == 1, F.lit(False)))
    rows = rows.withColumn("label", F.coalesce(F.when(F.col("exact"), F.col("least")).otherwise(F.col("own")), F.lit("")))
    order = [F.desc("exact"), F.desc("size"), F.col("label"), F.col("cluster")]
    return ordinals(rows, order).select("cluster", "size", "exact", "label", "ordinal")
