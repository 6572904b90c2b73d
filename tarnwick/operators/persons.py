"""People whose names are compatible: identities of given and family name, pairs of them, members, recall of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import persons


def identities(people: DataFrame, label: str) -> DataFrame:
    """`people` with given and family; rows whose name is null or has no words go."""
    named = people.withColumn("__parts", persons.parts(label))
    return named.withColumns({"given": F.col("__parts.given"), "family": F.col("__parts.family")}).drop("__parts").filter("given is not null")


def pairs(people: DataFrame, label: str) -> DataFrame:
    """(family, a, b): different given names of one family that are compatible, a before b.

    However many people bear a name, it is one row here: names are made distinct before they meet, so pairs follow the
    different given names of a family and not its people. They meet by class or first letters, never by the family alone.
    """
    names = identities(people, label).select("given", "family").distinct()
    keyed = names.select("given", "family", F.explode(persons.keys(F.col("given"), F.col("family"))).alias("key"))
    a, b = keyed.select("key", "family", F.col("given").alias("a")), keyed.select("key", F.col("given").alias("b"))
    return a.join(b, "key").filter((F.col("a") < F.col("b")) & persons.compatible(F.col("a"), F.col("b"))).select("family", "a", "b").distinct()


def recall(people: DataFrame, label: str, catalog: DataFrame, canonical: str, name: str) -> DataFrame:
    """(label, canonical, name, score) for each different label and each catalog name whose family is its own and whose given name is compatible."""
    asked = identities(people.select(F.col(label).alias("label")).distinct(), "label")
    known = identities(catalog.select(F.col(canonical).alias("canonical"), F.col(name).alias("name")).distinct(), "name").withColumnsRenamed({"given": "own", "family": "own_family"})
    left = asked.select("*", F.explode(persons.keys(F.col("given"), F.col("family"))).alias("key"))
    right = known.select("*", F.explode(persons.keys(F.col("own"), F.col("own_family"))).alias("key"))
    met = left.join(right, "key").filter(persons.compatible(F.col("given"), F.col("own"))).select("label", "canonical", "name").distinct()
    return met.withColumn("score", persons.overlap("label", "name"))
