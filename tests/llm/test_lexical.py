import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from tarnwick.llm import lexical

WORDS = [f"w{i}" for i in range(60)] + ["über", "café", "x-y", "a1B2", "ends."]


def texts(n, seed, most=40):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=rng.randint(1, most))) for _ in range(n)]


def tables(spark, docs, items):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, term string").repartition(4)
    return frame, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, q int")


DOCS = [(i, t) for i, t in enumerate(texts(300, 1))] + [(900, None), (901, ""), (902, "- . -"), (3, "w1 w1 w2"), (3, "w1 w1 w2"), (None, "w9 w9 über"), (None, "W9 w9 ÜBER"), (903, "w5 " * 5000)]
ITEMS = [(i, t) for i, t in enumerate(texts(25, 2, 12))] + [(50, None), (51, ""), (52, "unknown"), (53, "w1"), (53, "w2 w3"), (None, "über w9"), (54, "W1 w1 W2 unknown")]


@pytest.mark.parametrize("shard, run, postings, k", [(4096, 16, 1 << 20, 10), (16, 4, 1 << 20, 3), (50, 1, 60, 10)])
def test_matches_brute_force(spark, monkeypatch, shard, run, postings, k):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "RUN", run)
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    docs, items = tables(spark, DOCS, ITEMS)
    index = lexical.materialise(lexical.build_index(docs), "index")
    got = Counter(map(tuple, lexical.search(index, items, k=k).collect()))
    assert got == Counter(lexical.brute_force(DOCS, ITEMS, k))


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    docs, items = tables(spark, DOCS, ITEMS)
    index = lexical.materialise(lexical.build_index(docs), "index")
    assert Counter(map(tuple, lexical.search(index, items, k=4).collect())) == Counter(lexical.brute_force(DOCS, ITEMS, 4))


@pytest.mark.parametrize("docs, items", [([], ITEMS), (DOCS[:5], []), ([(1, None)], ITEMS), (DOCS[:5], [(1, "nothing here")])])
def test_empty(spark, docs, items):
    docs, items = tables(spark, docs, items)
    assert lexical.search(lexical.materialise(lexical.build_index(docs), "index"), items).count() == 0


def test_long_documents_have_exact_norms():
    """Beyond 64 bits the product is formed in whole numbers."""
    assert lexical.norms(np.array([10**9, 7]), 10**12, 10**15).tolist() == [10 + 90 * 10**9 * 10**12 // 10**15, 10 + 90 * 7 * 10**12 // 10**15]


def shard_of(pairs, n, seed, share=0.3):
    """A shard where two terms are at their best in different documents."""
    rng = np.random.default_rng(seed)
    lists = {}
    for t in range(2 * pairs):
        docs = np.flatnonzero(rng.random(n) < share)
        lists[t] = docs, rng.integers(1, 1000, len(docs))
    block = lexical.Queries([0], [[b"%03d" % t for t in range(2 * pairs)]], {}, (1, 1))
    joint = lexical._joint(lists, block, n)
    return lexical.Shard(np.arange(n), lists, lexical.dense(lists, n), joint), block.pairs[0]


def test_pair_bounds_skip_more_than_single_terms():
    """No document exceeds its run's bound, and pairs leave fewer documents to score than independent maxima do."""
    shard, pairs = shard_of(2, 4096, 5, 0.1)
    whole = np.zeros(4096, np.int64)
    for docs, impacts in shard.lists.values():
        whole[docs] += impacts
    bound = np.sum([shard.bound(p) for p in pairs], axis=0)
    assert (np.repeat(bound, lexical.RUN) >= whole).all()
    cutoff = int(np.sort(whole)[-3])
    met = []
    at, scores = shard.score(pairs, cutoff, met=met)
    assert sorted(zip(at, scores)) == sorted((i, s) for i, s in enumerate(whole) if s >= cutoff)
    singles = np.sum([shard.maxima[t] for p in pairs for t in p], axis=0) >= cutoff
    assert met[0] < lexical.RUN * singles.sum() / 2


def test_joint_maxima_decide():
    """Without the intersection lists a run that holds the answer would be dropped."""
    shard, pairs = shard_of(2, 256, 7)
    whole = np.zeros(256, np.int64)
    for docs, impacts in shard.lists.values():
        whole[docs] += impacts
    cutoff = int(np.sort(whole)[-5])
    assert len(shard.score(pairs, cutoff)[0]) >= 5
    blind = lexical.Shard(shard.ids, shard.lists, shard.maxima, {p: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for p in pairs})
    assert len(blind.score(pairs, cutoff)[0]) < 5


def test_a_task_never_holds_all_its_shards(spark, tmp_path, monkeypatch):
    """However many shards a file has, they stand in row groups of a few."""
    monkeypatch.setattr(lexical, "SHARD", 8)
    monkeypatch.setattr(lexical, "BATCH", 1 << 12)
    monkeypatch.setitem(lexical.LONG_ROWS, "parquet.block.size", 1 << 12)
    written = {}
    monkeypatch.setattr(lexical, "materialise", lambda df, name="t", keep=lexical.materialise, **o: written.setdefault(name, keep(df, name, **o)))
    docs, items = tables(spark, DOCS, ITEMS)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(size)
    got = Counter(map(tuple, lexical.op11_lexical(spark, str(tmp_path)).collect()))
    assert got == Counter(lexical.brute_force(DOCS, ITEMS, 10)) and spark.conf.get(size) == before
    files = [pq.ParquetFile(f).metadata for f in Path(written["index"]._scratch.removeprefix("file://")).glob("*.parquet")]
    rows = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(rows) > 30 and max(rows) <= 8
