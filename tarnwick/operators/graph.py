"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.session import materialise, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of an edge the smallest node it can reach; a root is listed with itself.

    Every round turns each node's neighbours to the smallest among them: first the larger
    neighbours (large star), then the smaller ones (small star). What a round needs of a
    node is a minimum, so busy nodes are pre-aggregated before the shuffle, and the join
    back is one that Spark can split. The number of rounds is the logarithm of the longest
    chain. Each round's edges are a written table, so lineage stays short.
    Loops and nulls are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u != v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # each minimum is a written table, so both sides of the join behind it are plain exchanges
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = materialise(large.distinct(), "stars")
        lowest = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        old, e = e, materialise(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(old, least, large, lowest)
        # done when every node has one parent and no parent has one itself
        n, different = e.agg(F.count("*"), F.count_distinct("u")).first()
        if n == different and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
