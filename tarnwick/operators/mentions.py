"""Mentions of entities in articles: arms, counts, timelines, occurrences, hubs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.session import spread

def arms(**kinds: DataFrame) -> DataFrame:
    """The union of mention tables (article, entity, nature, active) with their kind."""
    return reduce(lambda a, b: a.unionByName(b), (df.withColumn("kind", F.lit(k)) for k, df in kinds.items()))


def counts(mentions: DataFrame, key: str = "entity") -> DataFrame:
    """Active mentions and different articles of each entity."""
    return mentions.filter("active").groupBy(key).agg(F.count("*").alias("mentions"), F.count_distinct("article").alias("stories"))


def at_least(mentions: DataFrame, n: int, key: str = "entity") -> DataFrame:
    return mentions.filter("active").groupBy(key).agg(F.count("*").alias("mentions")).filter(F.col("mentions") >= n)


def timeline(mentions: DataFrame, date: str) -> DataFrame:
    """Mentions of each date that has any; rows without a date drop and gaps stay gaps."""
    return mentions.filter(F.col("active") & F.col(date).isNotNull()).groupBy(date).agg(F.count("*").alias("mentions"))


def hub(articles: DataFrame, mentions: DataFrame, kinds: list[str]) -> DataFrame:
    """For each article the active mentions and different entities of each kind, zeros included."""
    # a row for each article, kind and entity first: then plain sums do, where several distinct counts would multiply the rows
    # all of it within articles, which are dealt once
    each = spread(mentions.filter("active"), "article").groupBy("article", "kind", "entity").agg(F.count("*").alias("n"))
    sums = []
    for k in kinds:
        mine = F.col("kind") == k
        sums += [F.sum(F.when(mine, F.col("n")).otherwise(0)).alias(f"{k}_mentions"), F.count(F.when(mine, F.col("entity"))).alias(f"{k}_entities")]
    found = each.groupBy("article").agg(*sums)
    columns = [c for k in kinds for c in (f"{k}_mentions", f"{k}_entities")]
    return articles.join(found, "article", "left").fillna(0, columns)


def first_occurrence(occurrences: DataFrame, mention: str, order: list[Column]) -> DataFrame:
    """Each mention's first occurrence that isn't suppressed."""
    first = Window.partitionBy(mention).orderBy(*order)
    return occurrences.filter("not suppressed").withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def quoted(text: str, label: str) -> Column:
    """Whether an occurrence is a quotation: by its quote text or its label."""
    return (F.trim(F.coalesce(F.col(text), F.lit(""))) != "") | (F.lower(F.trim(F.coalesce(F.col(label), F.lit("")))) == "quote")


def recent_activity(entities: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Entities with the later of their own and their children's last change."""
    latest = children.groupBy(key).agg(F.max("updated").alias("__child"))
    return entities.join(latest, key, "left").withColumn("active_at", F.greatest("updated", "__child")).drop("__child")


def both_ways(edges: DataFrame, kind: str, node) -> DataFrame:
    """Edges that leave or reach a node, with the other end; two scans of one filter each instead of an OR."""
    out = edges.filter((F.col("from_type") == kind) & (F.col("from_id") == node)).select("*", F.col("to_type").alias("other_type"), F.col("to_id").alias("other_id"))
    back = edges.filter((F.col("to_type") == kind) & (F.col("to_id") == node) & ~((F.col("from_type") == kind) & (F.col("from_id") == node)))
    return out.unionByName(back.select("*", F.col("from_type").alias("other_type"), F.col("from_id").alias("other_id")))


def co_mentions(mentions: DataFrame, left: str, right: str, least: int = 2) -> DataFrame:
    """(a, b, stories): entities of two kinds that active mentions put in the same articles."""
    seen = mentions.filter("active").select("article", "kind", "entity").distinct()
    a = seen.filter(F.col("kind") == left).select("article", F.col("entity").alias("a"))
    b = seen.filter(F.col("kind") == right).select("article", F.col("entity").alias("b"))
    return a.join(b, "article").groupBy("a", "b").agg(F.count("*").alias("stories")).filter(F.col("stories") >= least)
