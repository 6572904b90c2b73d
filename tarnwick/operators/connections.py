"""Edges between entities: from shared stories, affiliations and equal names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.functions import geo, text
from tarnwick.operators.articles import per_group

CONFIDENCE, PER_ARTICLE = 0.9, 20


def valid(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Proposed edges (article, from_type, from_id, to_type, to_id, nature, confidence, quote) that may stand:
    sure enough, with a quote, of types that `rules` (from_type, to_type, nature) allow, no loop; at most 20 an article, surest first."""
    sure = (F.col("confidence") >= CONFIDENCE) & (F.trim(F.coalesce("quote", F.lit(""))) != "")
    loop = (F.col("from_type") == F.col("to_type")) & (F.col("from_id") == F.col("to_id"))
    kept = candidates.filter(sure & ~loop).join(rules, ["from_type", "to_type", "nature"], "left_semi")
    ends = ["from_type", "from_id", "to_type", "to_id", "nature"]
    best = per_group(kept, ["article", *ends], [F.desc("confidence"), F.col("quote")], 1)
    return per_group(best, ["article"], [F.desc("confidence"), *map(F.col, ends)], PER_ARTICLE)


def subsumed(edges: DataFrame, weaker: DataFrame) -> DataFrame:
    """Edges less those that a stronger nature between the same ends already says (`weaker`: nature, by)."""
    ends = ["from_type", "from_id", "to_type", "to_id"]
    implied = edges.join(weaker.select(F.col("by").alias("nature"), F.col("nature").alias("__weak")), "nature").select(*ends, F.col("__weak").alias("nature"))
    return edges.join(implied.distinct(), [*ends, "nature"], "left_anti")


def in_order(connections: DataFrame, node: str, limit: int) -> DataFrame:
    """(node, other_type, other_id, label) with `place`: the first `limit` connections of each node by the other end's label, type and id."""
    order = [F.lower("label"), F.col("other_type"), F.col("other_id")]
    return connections.withColumn("place", F.row_number().over(Window.partitionBy(node).orderBy(*order))).filter(F.col("place") <= limit)


def affiliations(people: DataFrame, organizations: DataFrame) -> DataFrame:
    """(person, organization): an affiliation text that holds all of an organization's tokens, of which there are two at least.

    They meet by the organization's longest token, so a common word joins nothing.
    """
    p = people.select("person", text.tokens("affiliation").alias("pt")).withColumn("token", F.explode("pt"))
    longest = F.array_max(F.transform(F.col("ot"), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    o = organizations.select("organization", text.tokens("label").alias("ot")).filter(F.size("ot") >= 2).withColumn("token", longest)
    return p.join(o, "token").filter(F.size(F.array_except("ot", "pt")) == 0).select("person", "organization").distinct()


def same_head(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b) whose names agree before the first comma."""
    head = lambda df, k: df.select(F.col("id").alias(k), text.block_key("label", "comma_head").alias("head")).filter("head != ''")
    return head(a, "a").join(head(b, "b"), "head").select("a", "b")


def place_groups(places: DataFrame, metres: float = 300.0) -> DataFrame:
    """(a, b) of one document's places to be made one: same folded name, type family and jurisdiction, and the same identity, or no
    further apart than `metres`, or one of them resolved and the other in review."""
    p = places.withColumn("key", text.fold_key("name"))
    side = lambda s: p.select("doc", "key", "family", "jurisdiction", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "identity", "lon", "lat", "state")))
    j = side("a").join(side("b"), ["doc", "key", "family", "jurisdiction"]).filter("id_a < id_b")
    same = F.coalesce(F.col("identity_a") == F.col("identity_b"), F.lit(False))
    near = F.coalesce(geo.haversine("lon_a", "lat_a", "lon_b", "lat_b") * 1000 <= metres, F.lit(False))
    mixed = ((F.col("state_a") == "resolved") & (F.col("state_b") == "review")) | ((F.col("state_a") == "review") & (F.col("state_b") == "resolved"))
    return j.filter(same | near | mixed).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def qa_flags(asked_kind: str, found_kind: str, asked_state: str, found_state: str, asked_city: str, found_city: str) -> Column:
    """What is wrong with a geocoded place, joined by commas: fell back to a city, other region, other city, other level."""
    levels = ("country", "state", "county", "city", "neighborhood", "address")
    level = lambda c: F.array_position(F.array(*map(F.lit, levels)), F.col(c))
    flags = [
        F.when((level(asked_kind) > 4) & (level(found_kind) == 4), "city_fallback"),
        F.when(F.col(asked_state) != F.col(found_state), "region_mismatch"),
        F.when((F.col(asked_state) == F.col(found_state)) & (text.fold_key(asked_city) != text.fold_key(found_city)), "subnational_mismatch"),
        F.when((level(asked_kind) <= 3) & (level(asked_kind) != level(found_kind)), "level_mismatch"),
    ]
    return F.concat_ws(",", *flags)
