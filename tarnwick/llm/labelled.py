"""Bounded, reproducible samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, by remainder. A null id counts as text ''."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(modulus)) == remainder


def labelled(labels: DataFrame, label: str, *, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, y): one row for each document that may be learned from.

    Null ids and labels other than 0 and 1 are left out, and so are documents that carry both labels.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    return rows.filter(~held_out("doc_id", modulus, remainder))


def counts(rows: DataFrame) -> dict[int, int]:
    return {r.y: r["count"] for r in rows.groupBy("y").count().collect()}


def sample(rows: DataFrame, per_class: int) -> DataFrame:
    """At most `per_class` documents of each class, those of smallest hash, as (doc_id, y, draw in [0, 1)); so 2 * per_class rows at most."""
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    order = F.xxhash64(F.col("doc_id").cast("string"))
    one = lambda y: rows.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
    return one(0).unionByName(one(1)).withColumn("draw", draw)


def with_texts(picked: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, y, draw, text) of sampled documents, one row each: the smallest text where rows share an id.

    The sample has a proven bound, so it is the side to broadcast.
    """
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "y", "draw").agg(F.min("text").alias("text"))


def fit_logistic(x, y, weight, l2: float = 1e-3, steps: int = 50):
    """Newton's method for a weighted logistic regression with intercept (last coefficient); columns are used as given."""
    import numpy as np

    x = np.column_stack([np.asarray(x, float), np.ones(len(y))])
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        grad = x.T @ (weight * (p - y)) + ridge * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 10 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta
