import hashlib
import math
import random
import re

import pytest

from tarnwick.llm import mixing


def corpus(seed=1):
    rng = random.Random(seed)
    docs = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60))), "big" if i % 3 else f"s{i % 7}") for i in range(400)]
    docs += [(1000, None, "big"), (1001, "", None), (1002, "one two", None), (None, "no id", "big"), (1003, "a b c", "s1"), (1003, "a b c", "s1"), (1004, "x " * 9000, "s2"), (1005, "", "void")]
    return docs


def brute(docs, block_tokens, fanout, budget=None, max_repetition=None, entropy=None):
    rows = [(d, s or "", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in docs]
    totals = {}
    for _, s, n in rows:
        totals[s] = totals.get(s, 0) + n
    totals = {s: n for s, n in totals.items() if n}
    budget = budget or sum(totals.values())

    def ok(a):
        z = sum(t**a for t in totals.values())
        w = {s: t**a / z for s, t in totals.items()}
        return max(w[s] * budget / t for s, t in totals.items()) <= max_repetition if entropy is None else -sum(x * math.log(x) for x in w.values()) >= entropy

    lo, hi = 0.0, 1.0
    for _ in range(mixing.STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) == (entropy is None) else (mid, hi)
    a = (0.0 if ok(0.0) else hi) if entropy is None else (1.0 if ok(1.0) else lo)
    z = sum(t**a for t in totals.values())
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = []
    for s, total in totals.items():
        quota = math.floor(total**a / z * budget)
        epochs, left = divmod(quota, total)
        placed = []
        for d, source, n in rows:
            if source == s:
                name = "" if d is None else str(d)
                block = int(md5(f"block/{name}")[:15], 16) % max(1, -(-total // block_tokens))
                sup = block // fanout
                placed.append((f"{md5(f'0/{epochs}/super/{sup}')}/{sup}", f"{md5(f'0/{epochs}/block/{block}')}/{block}", f"{md5(f'0/{epochs}/doc/{name}')}/{name}", n, d))
        for x in placed:
            upto = sum(y[3] for y in placed if y[:3] <= x[:3])
            out.append((str(x[4]), s, x[3], epochs + (upto <= left)))
    return sorted(out), a


@pytest.mark.parametrize("target", [{"max_repetition": 1.5}, {"max_repetition": 3.0, "budget": 30_000}, {"entropy": 1.9}, {"max_repetition": 0.1}, {"entropy": 0.0}])
def test_matches_brute_force(spark, monkeypatch, target):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    monkeypatch.setattr(mixing, "FANOUT", 4)
    docs = corpus()
    frame = spark.createDataFrame([(*d, 3, "x") for d in docs], "doc_id long, text string, source string, tokens int, block string").repartition(3)
    rows = mixing._narrow(frame, "doc_id", "source", "text")
    found = mixing.copies(rows, mixing.plan(rows, **target)).collect()
    want, a = brute(docs, 200, 4, **target)
    assert sorted((str(r.doc_id), r.source, r.tokens, r.copies) for r in found) == want
    taken = mixing.mixture(frame, **target)
    assert taken.columns == [*frame.columns, "mix_copies", "mix_weight", "mix_order"]
    assert sorted((str(r.doc_id), r.source or "", r.mix_copies) for r in taken.collect()) == sorted((d, s, n) for d, s, _, n in want if n)


def test_budget_is_kept_and_used(spark):
    rows = spark.createDataFrame([(i, f"s{i % 5 if i % 2 else 0}", 7 + i % 11) for i in range(2000)], "doc_id long, source string, tokens long")
    plan = mixing.plan(rows, max_repetition=1.3)
    got = {r.source: r["sum(t)"] for r in mixing.copies(rows, plan).selectExpr("source", "copies * tokens as t").groupBy("source").sum("t").collect()}
    for r in plan.collect():
        assert r.quota - 18 <= got[r.source] <= r.quota
        assert r.quota <= 1.3 * r.tokens + 1


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixture(frame, max_repetition=2.0).count() == 0
