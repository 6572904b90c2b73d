import random

import numpy as np

from tarnwick.llm import near_dup as n
from tarnwick.operators.graph import components


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(400)]
    docs = []
    for g in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs) + 10, " ".join(copy).upper() if g % 2 else " ".join(copy)))
    docs += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c " * 90_000), (8, "a b c " * 90_000)]
    return docs


def test_matches_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, fp string, component_id int").repartition(5)
    rows = n.near_duplicates(frame).collect()
    assert {r.doc_id: (f"{r.fp % 2**64:016x}", r.component_id) for r in rows} == n.brute_force(docs)
    kept = n.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in n.brute_force(docs).values()})


def prints(count=300, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-(2**63), 2**63 - 1, 12, dtype=np.int64)
    out = set()
    while len(out) < count:
        x = int(rng.choice(centres)) % 2**64
        for k in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(k)
        out.add(x - 2**64 if x >= 2**63 else x)
    return sorted(out)


def groups(rows):
    root = {x: x for x in rows}
    changed = True
    while changed:
        changed = False
        for x in rows:
            for y in rows:
                if bin((x ^ y) % 2**64).count("1") <= 3 and root[y] > root[x]:
                    root[y], changed = root[x], True
    return root


def test_no_link_is_lost_hot_or_not(spark, monkeypatch):
    fps = prints()
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(fps)], "doc_id long, fp long")
    want = groups(fps)
    ids = {x: i for i, x in enumerate(fps)}
    for hot, step in ((20_000, 1 << 16), (3, 1 << 16), (20_000, 64)):
        monkeypatch.setattr(n, "HOT", hot)
        monkeypatch.setattr(n, "STEP", step)
        got = {r.fp: r.component_id for r in n.grouped(frame).collect()}
        assert got == {x: ids[want[x]] for x in fps}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "other words stand here today"), (2, "A b C d e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = n.near_duplicates(frame).collect()
    assert len(found) == 5 and {r.component_id for r in found} == {1, None}
    assert sorted(str(r.doc_id) for r in n.keep_one(frame).collect()) == ["1", "None", "None"]
    assert n.near_duplicates(frame.limit(0)).count() == 0 and n.keep_one(frame.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
