"""Quality classifier by compression with Zstandard dictionaries.

One dictionary is built from good and one from bad labelled text. A text is cut into
pieces of `PIECE` bytes, so that neither dictionary drowns in a long text's own history,
and every piece is compressed against each. The difference of the two compressed sizes
over the text's size says which kind it resembles; the compressed size itself says how
repetitive it is. A logistic curve, fitted on labelled documents that built no
dictionary, turns these into the probability of label 1.

Learning reads at most `PER_CLASS` documents of each class (the documented bound of the
sample) and at most `PIECES` pieces of each for the dictionaries. Scoring is one narrow
pass over all texts with two broadcast dictionaries of `DICT_BYTES` at most.

Defined cases: a null text counts as empty, an empty text gets the score of zero evidence
(the share of label 1); labels that are null, foreign or contradictory are not learned
from; with labels of one class only, every score is that class; with none, 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm import labelled
from tarnwick.llm.batches import map_batches, texts
from tarnwick.session import materialise, table

PER_CLASS = 3_000
PIECE = 2_048
PIECES = 4_096
DICT_BYTES = 112_640
LEVEL = 3
#: Added to a text's size, so that a few bytes are weak evidence.
SHRINK = 64
THRESHOLD = 0.7


class Model:
    """Two dictionaries and the curve; sent to executors as plain bytes."""

    def __init__(self, bad: bytes, good: bytes, curve: list[float]) -> None:
        self.bad, self.good, self.curve = bad, good, curve
        self._ready = None

    def __getstate__(self):
        return self.bad, self.good, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, text: bytes) -> tuple[float, float, float]:
        """(difference, compressed size, the same logged), each over the text's size; zeros for an empty text."""
        if not text:
            return 0.0, 0.0, 0.0
        if self._ready is None:
            self._ready = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (self.bad, self.good)]
        bad = good = 0
        for i in range(0, len(text), PIECE):
            piece = text[i : i + PIECE]
            bad += len(self._ready[0].compress(piece))
            good += len(self._ready[1].compress(piece))
        size = len(text) + SHRINK
        ratio = min(bad, good) / size
        return 10 * (bad - good) / size, ratio - 0.4, float(np.log(ratio + 0.01) - np.log(0.41))

    def score(self, text: bytes) -> float:
        z = self.curve[-1] + (float(np.dot(self.curve[:-1], self.features(text))) if text else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples to choose from: take them as they are
        return b"".join(pieces)[-DICT_BYTES:] or b" "


def _pieces(sampled: DataFrame) -> DataFrame:
    """(y, rank, piece): the texts cut up, each piece with a hash to choose by."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ys, at, parts = [], [], []
        for doc, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "text"), strict=True):
            for i in range(0, len(text), PIECE):
                ys.append(y)
                at.append(f"{doc}/{i}")
                parts.append(text[i : i + PIECE])
        return pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(at, pa.string()), pa.array(parts, pa.binary())], ["y", "at", "piece"])

    return map_batches(sampled.select("doc_id", "y", "text"), cut, "y int, at string, piece binary").withColumn("rank", F.xxhash64("at"))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", modulus: int = 4, remainder: int = 2, per_class: int = PER_CLASS) -> Model:
    rows = labelled.labelled(labels, label, modulus=modulus, remainder=remainder)
    share = labelled.counts(rows)
    if len(share) < 2:
        only = next(iter(share), None)
        return Model(b" ", b" ", [0.0, 0.0, 0.0, 0.0 if only is None else 40.0 * (2 * only - 1)])
    sampled = materialise(labelled.with_texts(labelled.sample(rows, per_class), docs), "sample")
    pieces = _pieces(sampled.filter("draw < 0.5"))
    chosen = [[bytes(r.piece) for r in pieces.filter(F.col("y") == y).orderBy("rank", "at").limit(PIECES).collect()] for y in (0, 1)]
    model = Model(*map(_dictionary, chosen), [0.0] * 4)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.features(t) for t in texts(batch, "text")]
        cols = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in cols)], ["y", "a", "b", "c"])

    tuned = map_batches(sampled.filter("draw >= 0.5").select("y", "text").filter("text != ''"), measure, "y int, a double, b double, c double").toPandas()
    y = tuned["y"].to_numpy(float)
    if len(set(y)) < 2:  # a handful of labels: no curve can be fitted, the sign of the difference decides
        prior = float(np.log(share[1] / share[0]))
        return Model(model.bad, model.good, [10.0, 0.0, 0.0, prior])
    # each class counts as often as among all labels
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum()) * len(y) / (share[0] + share[1])
    model.curve = [float(b) for b in labelled.fit_logistic(tuned[["a", "b", "c"]].to_numpy(), y, weight)]
    prior = float(np.log(share[1] / share[0]))
    return Fitted(model.bad, model.good, model.curve, prior)


class Fitted(Model):
    """A fitted curve whose value for an empty text is the share of label 1."""

    def __init__(self, bad: bytes, good: bytes, curve: list[float], prior: float) -> None:
        super().__init__(bad, good, curve)
        self.prior = prior

    def __getstate__(self):
        return self.bad, self.good, self.curve, self.prior

    def score(self, text: bytes) -> float:
        return super().score(text) if text else float(1 / (1 + np.exp(-self.prior)))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", into: str = "quality_score", keep_text: bool = True) -> DataFrame:
    """`docs` with the probability of label 1 in `into`; a column of that name is replaced, all others pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name != into and (keep_text or f.name != text_col)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([shared.value.score(t) for t in texts(batch, text_col)], pa.float64())
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), found], [*(f.name for f in keep), into])

    return map_batches(docs, run, T.StructType([*keep, T.StructField(into, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, columns unchanged."""
    mark = "quality_score" if "quality_score" not in docs.columns else "__quality_score"
    return score(docs, train(docs, labels, **options), into=mark).filter(F.col(mark) >= threshold).drop(mark)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's score, learned from labels whose crc32 leaves no remainder 2 by 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, into="score", keep_text=False).select(
        "doc_id", labelled.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
