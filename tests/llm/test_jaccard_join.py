import random
from collections import Counter

import numpy as np
import pytest

from tarnwick.llm import jaccard_join


def changed(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    return words


def family(rng, size, most, length=120):
    """Near copies of one text, some beyond the threshold of others."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(length)]
    return [" ".join(changed(rng, base, rng.randint(0, most))) for _ in range(size)]


def docs(seed, families=6, size=8, most=5):
    rng = random.Random(seed)
    out = [t for _ in range(families) for t in family(rng, size, most, rng.choice([40, 120, 300]))]
    # a passage that many documents share, and texts at the edges
    passage = " ".join(f"p{i}" for i in range(40))
    out += [passage + " " + " ".join(f"q{rng.randrange(10**5)}" for _ in range(rng.choice([1, 2, 3, 30]))) for _ in range(30)]
    out += ["", None, " \n", "one", "One", "one two", "ONE two", "two one", "a b c", "A B  C", "a b c a b c", "ü Ü x y", "ü ü x y", "z " * 3000]
    out += out[:10]
    rng.shuffle(out)
    rows = list(enumerate(out))
    return rows + [(3, "clash of an id"), (None, out[5]), (None, "no id at all")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, content string").repartition(5)


@pytest.mark.parametrize("small, families, size, most", [(64, 6, 8, 5), (3, 4, 25, 9), (64, 2, 90, 12)])
def test_matches_brute_force(spark, monkeypatch, small, families, size, most):
    """Pairs formed, and compared by blocks: with a low limit, and with families larger than the limit in several components."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rows = docs(small + size, families, size, most)
    got = Counter(map(tuple, jaccard_join.joined(frame(spark, rows)).collect()))
    assert got == Counter(jaccard_join.brute_force(rows))


def test_blocks_decide(spark, monkeypatch):
    """Links that neither stars nor pairs find come from the comparison by blocks."""
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    rows = docs(5, 3, 40, 9)
    want = Counter(jaccard_join.brute_force(rows))
    assert Counter(map(tuple, jaccard_join.joined(frame(spark, rows)).collect())) == want
    monkeypatch.setattr(jaccard_join, "blocks", lambda big, sets: None)
    assert Counter(map(tuple, jaccard_join.joined(frame(spark, rows)).collect())) != want


def test_needs_grow_with_cost_and_lose_no_pair(spark):
    """Sets in busy tokens choose longer prefixes; all similar pairs share as many of them as the smaller need."""
    rng = random.Random(9)
    texts = family(rng, 30, 3) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(10)]
    rows = list(enumerate(texts))
    source = jaccard_join._texts(frame(spark, rows), "doc_id", "text")
    sized, magnitude = jaccard_join.sized(source, 3)
    runs = jaccard_join.adapted(jaccard_join.prefixes(source, magnitude, 3)).collect()
    assert {r.need for r in runs} > {1} or min(r.need for r in runs) > 1
    tokens, need = {}, {}
    for r in runs:
        tokens.setdefault(r.content, set()).add(r.token)
        need[r.content] = r.need
    sets = {jaccard_join.content(h): set(h.tolist()) for t in texts if len(h := jaccard_join.shingled(t.encode(), 3)[1])}
    pairs = 0
    for x, a in sets.items():
        for y, b in sets.items():
            if x < y and 100 * len(a & b) >= 90 * len(a | b):
                pairs += 1
                assert len(tokens[x] & tokens[y]) >= min(need[x], need[y])
    assert pairs > 20


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], [(4, "same text of five words"), (2, "same text of five words")]])
def test_small_tables(spark, rows):
    got = jaccard_join.joined(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(jaccard_join.brute_force(rows))


def test_prints_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(4)
    for n in [1, 2, 15, 16, 40, 500, 511, 512, 1023, 5000]:
        for gone in {0, 1, n // 20, n // 10, n // 2, n}:
            x = rng.integers(0, 2**63, n, dtype=np.uint64)
            y = np.concatenate([x[gone:], rng.integers(0, 2**63, gone // 2 + 1, dtype=np.uint64)])
            p, q = jaccard_join.parity(x), jaccard_join.parity(y)
            words = min(len(p), len(q))
            bits = int(np.bitwise_count(jaccard_join.folded(p, words) ^ jaccard_join.folded(q, words)).sum())
            assert bits <= len(np.setxor1d(x, y))
            if jaccard_join.similar(np.sort(x), np.sort(y)):
                assert not jaccard_join.apart_by(bits, len(x) + len(y))
    # without chance hits there are as many bits as differences
    far = jaccard_join.parity(rng.integers(0, 2**63, 1000, dtype=np.uint64)) ^ jaccard_join.parity(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    assert jaccard_join.apart_by(int(np.bitwise_count(far).sum()), 2000)


@pytest.mark.parametrize("small, size", [(64, 2), (3, 10)])
def test_sets_of_far_candidates_are_not_sent(spark, monkeypatch, small, size):
    """Texts that share their rare shingles, but less than nine tenths of all, meet as prints alone."""
    rng = random.Random(6)
    texts = []
    for g in range(40 // size):
        rare = [f"r{g}x{i}" for i in range(100)]
        texts += [" ".join(rare + [f"c{rng.randrange(20)}" for _ in range(40)]) for _ in range(size)]
    texts += family(rng, 4, 2)
    rows = list(enumerate(texts))
    sent, write, verify = [], jaccard_join.materialise, jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, sets: sent.append(pairs.count()) or verify(pairs, sets))

    def written(df, name):
        out = write(df, name)
        if name == "active":
            sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialise", written)
    candidates = []
    stars, pairs = jaccard_join.stars, jaccard_join.pairs
    for name, f in (("stars", stars), ("pairs", pairs)):
        monkeypatch.setattr(jaccard_join, name, lambda runs, f=f: (lambda df: candidates.append(df.count()) or df)(f(runs)))
    assert Counter(map(tuple, jaccard_join.joined(frame(spark, rows)).collect())) == Counter(jaccard_join.brute_force(rows))
    assert sum(candidates) > 20 and sum(sent) < 20
