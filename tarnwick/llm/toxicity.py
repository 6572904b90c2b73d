"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes ratios.

Features are the distinct character n-grams (lengths `SIZES`, in code points) of a text with A-Z lowered
and white space made one space, hashed into `2 ** BITS` buckets per length. A feature counts
by its presence, scaled by the log of the ratio of its shares among toxic and other
documents; a ridge logistic regression on the scaled features gives the weights. Only
the `FEATURES` buckets whose ratio is most significant take part, so a long clean text
doesn't collect a score from thousands of weak features.

Learning reads at most `PER_CLASS` documents of each class (the documented bound of the
sample); document frequencies are counted in Spark, and what reaches the driver is bounded
by PER_CLASS and FEATURES. Scoring is one narrow pass with a broadcast table of weights
of fixed size.

Defined cases: a null text counts as empty; an empty text has no features, so it gets the
model's intercept; labels that are null, foreign or contradictory are not learned from;
with labels of one class only, every score is that class; with none, 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm import labelled
from tarnwick.llm.batches import map_batches, texts
from tarnwick.session import materialise, table

PER_CLASS = 4_000
SIZES = (4, 6)
BITS = 19
FEATURES = 8_192
#: Least squared score of a feature's difference between the classes.
LEAST_Z = 3.5
L2 = 2.0
THRESHOLD = 0.5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Characters hashed at a time; pieces of a long text overlap, so no n-gram is lost.
CHUNK = 1 << 18


def characters(text: bytes) -> np.ndarray:
    """Code points of a text: A-Z lowered, white space made one space, one space before and behind."""
    whole = b" " + b" ".join(text.lower().split()) + b" "
    return np.frombuffer(whole.decode(errors="replace").encode("utf-32-le"), np.uint32)


def grams(points: np.ndarray) -> np.ndarray:
    """Hashed n-grams of a run of characters, repeats included."""
    c = points.astype(np.uint64) + np.uint64(1)
    out = []
    rolled, size = c, 1
    for k, n in enumerate(SIZES):
        while size < n:
            rolled = rolled[:-1] * _BASE + c[size:] if len(rolled) > 1 else rolled[:0]
            size += 1
        h = (rolled ^ (rolled >> np.uint64(32))) * _MIX
        out.append(((h >> np.uint64(64 - BITS)) + np.uint64(k << BITS)).astype(np.int32))
    return np.concatenate(out)


def _parts(text: bytes):
    points = characters(text)
    step = CHUNK - max(SIZES)
    for i in range(0, len(points), step):
        yield grams(points[i : i + CHUNK])


def distinct(text: bytes, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct features of a text, or those among them that `wanted` marks."""
    return np.unique(np.concatenate([np.unique(g if wanted is None else g[wanted[g]]) for g in _parts(text)]))


class Model:
    def __init__(self, weights: np.ndarray, intercept: float) -> None:
        self.weights, self.intercept = weights.astype(np.float32), intercept
        self.used = self.weights != 0

    def score(self, text: bytes) -> float:
        z = self.intercept + float(self.weights[distinct(text, self.used)].sum(dtype=np.float64)) if text else self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _frequencies(sampled: DataFrame) -> DataFrame:
    """(feature, toxic, other): documents of each class that hold it; summed per batch before the shuffle."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = np.zeros((2, len(SIZES) << BITS), np.int32)
        for y, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
            seen[y][distinct(text)] += 1
        at = np.flatnonzero(seen.any(0))
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[1][at]), pa.array(seen[0][at])], ["feature", "toxic", "other"])

    found = map_batches(sampled.select("y", "text"), count, "feature int, toxic int, other int")
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", modulus: int = 5, remainder: int = 0, per_class: int = PER_CLASS) -> Model:
    rows = labelled.labelled(labels, label, modulus=modulus, remainder=remainder)
    share = labelled.counts(rows)
    size = len(SIZES) << BITS
    if len(share) < 2:
        only = next(iter(share), None)
        return Model(np.zeros(size), 0.0 if only is None else 40.0 * (2 * only - 1))
    picked = labelled.sample(rows, per_class)
    sampled = materialise(labelled.with_texts(picked, docs).filter("text != ''"), "sample")
    n = labelled.counts(picked)
    p, q = F.col("toxic") / n[1], F.col("other") / n[0]
    pooled = (F.col("toxic") + F.col("other")) / (n[0] + n[1])
    z = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]) + 1e-12)
    ratio = F.log((F.col("toxic") + 1) / (n[1] + 2)) - F.log((F.col("other") + 1) / (n[0] + 2))
    best = _frequencies(sampled).select("feature", ratio.alias("r"), z.alias("z")).filter(F.col("z") >= LEAST_Z)
    best = best.orderBy(F.desc("z"), "feature").limit(FEATURES).toPandas()
    features, r = best["feature"].to_numpy(np.int64), best["r"].to_numpy(float)
    column = np.full(size, -1, np.int32)
    column[features] = np.arange(len(features))
    shared = docs.sparkSession.sparkContext.broadcast(column)

    def active(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value[distinct(t, shared.value >= 0)] for t in texts(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["y", "columns"])

    held = map_batches(sampled.select("y", "text"), active, "y int, columns array<int>").toPandas()
    y = held["y"].to_numpy(float)
    if len(set(y)) < 2:  # labelled documents without text: nothing but the share of label 1 is known
        return Model(np.zeros(size), float(np.log(share[1] / share[0])))
    weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum())) * len(y) / (share[0] + share[1])
    beta, intercept = _ridge([np.asarray(c, np.int64) for c in held["columns"]], y, weight, r)
    weights = np.zeros(size)
    weights[features] = beta * r
    return Model(weights, intercept)


def _ridge(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, r: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times `r`, by accelerated gradient steps on sparse rows."""
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    value = r[flat]
    beta, b = np.zeros(len(r)), float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    look, look_b, t = beta.copy(), b, 1.0
    # the largest curvature is at most a quarter of the largest squared row norm times the weights
    norms = np.bincount(owner, value**2, len(rows)) + 1
    rate = 1 / (0.25 * (weight * norms).sum() + L2)
    for _ in range(steps):
        z = look_b + np.bincount(owner, value * look[flat], len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        new = look - rate * (np.bincount(flat, value * g[owner], len(r)) + L2 * look)
        new_b = look_b - rate * g.sum()
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, look_b = new + (old - 1) / t * (new - beta), new_b + (old - 1) / t * (new_b - b)
        beta, b = new, new_b
    return beta, float(b)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", into: str = "toxicity", keep_text: bool = True) -> DataFrame:
    """`docs` with the probability of label 1 in `into`; a column of that name is replaced, all others pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name != into and (keep_text or f.name != text_col)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([shared.value.score(t) for t in texts(batch, text_col)], pa.float64())
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), found], [*(f.name for f in keep), into])

    return map_batches(docs, run, T.StructType([*keep, T.StructField(into, T.DoubleType())]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's score, learned from labels whose crc32 leaves a remainder by 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, into="score", keep_text=False).select(
        "doc_id", labelled.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
