import random

import numpy as np
import pytest

from tarnwick.llm import topk

INF, NAN = float("inf"), float("nan")


def brute(rows, k):
    import math

    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def rows(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    out = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) if i % 3 else rng.gauss(0, spread) for _ in range(dims)]) for i in range(n)]
    out[7:12] = [(i, [1.0] * dims) for i in range(7, 12)]
    return out + [(9001, None), (9002, [None] + [0.1] * (dims - 1)), (9003, [INF] * dims), (9004, [NAN] * dims), (None, [0.2] * dims), (9020, [0.3])]


@pytest.mark.parametrize("n, dims, k, spread", [(130, 6, 5, 1.0), (60, 9, 100, 1.0), (50, 3, 4, 1e6)])
def test_matches_brute_force(spark, n, dims, k, spread):
    data = rows(n, dims, n, spread)
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in data], "vec_id long, embedding array<double>, rank int, score double").repartition(4)
    v = topk.vectors(frame)
    got = topk.top_k(v, v.filter("vec_id % 20 = 0"), k).collect()
    assert sorted(map(tuple, got)) == brute(data, k)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 2)
    data = rows(130, 5, 1)
    v = topk.vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3))
    assert sorted(map(tuple, topk.top_k(v, v.filter("vec_id % 20 = 0"), 6).collect())) == brute(data, 6)


def test_empty(spark):
    v = topk.vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v, 3).count() == 0


def test_few_entries_are_completed():
    """A part that reaches half of the cutoff is rare; no entry that reaches the cutoff is missed."""
    rng = np.random.default_rng(5)
    c = np.floor(64 * (v := rng.normal(size=(20_000, 64))) / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    q = c[:200]
    parts = [q[:, :32] @ c[:, :32].T, q[:, 32:] @ c[:, 32:].T]
    whole = q @ c.T
    cutoff = -np.sort(-whole, axis=1)[:, 19]
    rows, cols, score = topk._read(parts, cutoff)
    assert len(rows) < 0.05 * whole.size and (score == whole[rows, cols]).all()
    assert (score >= cutoff[rows]).sum() == (whole >= cutoff[:, None]).sum()


def test_repeated_ids(spark):
    """A repeated id is a candidate per row, and a query once, with its smallest vector."""
    rows = [(0, [1.0, 1.0]), (0, [2.0, -1.0]), (1, [1.0, 0.0]), (1, [0.0, 3.0]), (2, [0.5, 0.5])]
    v = topk.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(v, v.filter("vec_id = 0"), 3).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 3 * 64 * 64), (0, 2, 1, 64 * 64), (0, 3, 2, 64 * 64)]
