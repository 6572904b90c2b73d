import random

import numpy as np
import pytest

from tarnwick.llm import substring_dup as s
from tarnwick.llm.fm_index import BitRank, FMIndex, WaveletMatrix, matching_statistics


def corpus(seed=4, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "ß,"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 70))] for _ in range(8)]
    docs = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 2)
            at = rng.randint(0, len(words))
            words[at:at] = p[cut:] if rng.random() < 0.5 else p
        docs.append((i * 3 % 181, "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))))
    docs += [(500, None), (501, ""), (502, " \t"), (503, "x " * 100), (504, "x " * 45), (505, "a b c " * 60), (506, "b c a " * 9), (507, "one two"), (None, docs[5][1]), (508, "q " + "long text goes on " * 9000)]
    return docs


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 37, 500)
    tree = WaveletMatrix(symbols, 37)
    for c in (0, 5, 36):
        base = tree.down(np.array([c]), np.array([0]))[0]
        for i in (0, 1, 63, 64, 65, 300, 500):
            assert tree.down(np.array([c]), np.array([i]))[0] - base == (symbols[:i] == c).sum()


def test_backward_search_counts():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(1, 4, 300), [0]])
    index = FMIndex(text, 4, 6)
    for length in range(1, 7):
        for at in range(0, 250, 17):
            pattern = text[at : at + length]
            low, high = np.array([0]), np.array([index.n])
            for c in pattern[::-1]:
                low, high = index.extend(np.array([c]), low, high)
            assert high[0] - low[0] == sum((text[i : i + length] == pattern).all() for i in range(len(text) - length + 1))


def test_matching_statistics_against_all_pairs():
    rng = np.random.default_rng(3)
    rows = [rng.integers(1, 3, rng.integers(5, 12)) for _ in range(40)]
    text = np.concatenate([np.concatenate([r, [0]]) for r in rows])
    starts = np.cumsum([0] + [len(r) + 1 for r in rows[:-1]])
    windows = np.array([len(r) - 4 for r in rows])
    at, matches, earlier = matching_statistics(FMIndex(text, 3, 5), text, starts, windows, 5)
    assert sorted(at) == sorted(a + i for a, n in zip(starts, windows) for i in range(n))
    every = {int(a): tuple(text[a : a + 5]) for a in at}
    for a, n, e in zip(at.tolist(), matches.tolist(), earlier.tolist()):
        same = [b for b in every if every[b] == every[a]]
        assert n == len(same) and e == (min(same) < a)


def test_search_decides_what_stands_earlier(monkeypatch):
    """A search that makes no steps must lose what a shard reports."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]

    def shard():
        out = s._Shard()
        for d in range(12):
            words = [f"d{d}.{i}" for i in range(4)] + passage[d % 3 : 24 + d % 3] + [rng.choice("abc") for _ in range(3)]
            out.rows.append((d, 0, d, 0, " ".join(words).encode()))
        return out

    rng.seed(8)
    batch = shard().search()
    masks = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
    seen, want = set(), {}
    rng.seed(8)
    for d, _, _, _, words in shard().rows:
        words = words.split(b" ")
        every = [tuple(words[i : i + s.WINDOW]) for i in range(len(words) - s.WINDOW + 1)]
        if mask := sum(1 << i for i, w in enumerate(every) if w in seen):
            want[d] = mask
        seen.update(every)
    assert masks == want and len(want) == 11
    for idle in ({"extend": lambda self, symbol, low, high: (low, high)}, {"shorten": lambda self, low: (low, low)}):
        with monkeypatch.context() as m:
            for name, f in idle.items():
                m.setattr(FMIndex, name, f)
            rng.seed(8)
            try:
                batch = shard().search()
            except IndexError:
                continue
            assert batch is None or dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())) != want


def test_equal_hashes_of_different_words_cut_nothing(monkeypatch):
    words = [f"u{i}" for i in range(300)]
    text = " ".join(words).encode()
    assert s.removed_words([text], [None]) == [None]
    whole = s.Segments.__init__

    def collide(self, texts):
        whole(self, texts)
        self.content = np.zeros_like(self.content)
        self.windows = np.minimum(self.windows, 1)

    monkeypatch.setattr(s.Segments, "__init__", collide)
    assert s.removed_words([text], [None]) == [None]


def test_places_of_ones():
    rng = np.random.default_rng(5)
    bits = (rng.random(1000) < 0.1).astype(np.uint8)
    ones = np.flatnonzero(bits)
    assert (BitRank(bits).place(np.arange(len(ones))) == ones).all()


@pytest.mark.parametrize(
    "hot, shard, group, salt, copies, anchor_rows",
    [(50_000, 1_000_000, 1 << 20, 20_000, 200_000, 10**7), (0, 1_000_000, 500, 20_000, 3, 10**7), (50_000, 200, 1 << 20, 2, 5, 0)],
)
def test_matches_brute_force(spark, monkeypatch, hot, shard, group, salt, copies, anchor_rows):
    for name, value in (("SALT", salt), ("COPIES", copies), ("ANCHOR_ROWS", anchor_rows)):
        monkeypatch.setattr(s, name, value)
    monkeypatch.setattr(s, "GROUP", group)
    monkeypatch.setattr(s, "HOT", hot)
    monkeypatch.setattr(s, "SHARD_WORDS", shard)
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 1, "y") for d, t in docs], "doc_id long, text string, doc int, content string").repartition(5)
    rows = s._with_cuts(frame, "doc_id", "text").select("doc_id", "text", "__cuts").collect()
    import hashlib

    got = {}
    for r in rows:
        words = (r.text or "").encode().split()
        gone = s.removed_words([(r.text or "").encode()], [[x.asDict() for x in r["__cuts"] or []]])[0]
        gone = np.zeros(len(words), bool) if gone is None else gone
        got[r.doc_id] = (len(words), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
    assert got == s.brute_force(docs)


def test_dedup_keeps_columns_and_clean_texts(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 1, "y") for d, t in docs], "doc_id long, text string, doc int, content string")
    kept = s.dedup(frame)
    assert kept.columns == frame.columns
    rows, want = {r.doc_id: r.text for r in kept.collect()}, s.brute_force(docs)
    for d, t in docs:
        total, removed, _ = want[d]
        if total and total == removed:
            assert d not in rows
        elif not removed:
            assert rows[d] == t
        else:
            assert len(rows[d].split()) == total - removed
    assert s.dedup(frame.limit(0)).count() == 0


def test_rows_without_an_id_are_judged_against_each_other(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows = [(None, " ".join(rng.choice(words) for _ in range(30)) + " " + passage, i) for i in range(40)] + [(None, None, 50), (None, "", 51), (None, "", 52)]
    kept = s.dedup(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)).collect()
    assert len(kept) == len(rows) and sum(passage in (r.text or "") for r in kept) == 1
