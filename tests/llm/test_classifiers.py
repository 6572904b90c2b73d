import random
import zlib

import pytest

from tarnwick.llm import labelled, quality, toxicity

WORDS = "river stone market garden window letter morning paper winter station engine bridge mirror basket candle".split()


def corpus(seed=3, n=240):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 300))]
        bad, toxic = i % 4 == 0, i % 5 == 1
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron"])
            words[rng.randrange(len(words))] = "clown"
        if bad:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), 0.5, 0.5))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(900, None, None, None), (901, "", None, None), (902, "short", 0.0, 0.0), (None, "river stone", 0.0, 0.0), (903, "river " * 60_000, 0.0, 0.0), (903, "river " * 60_000, 0.0, 0.0)]
    labels += [(900, 1, 0), (None, 1, 1), (905, None, None), (0, None, 7)]
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, quality_score double, toxicity double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


@pytest.mark.parametrize("module, label, modulus, remainder, threshold, name", [(quality, 1, 4, 2, 0.7, "quality_score"), (toxicity, 2, 5, 0, 0.5, "toxicity")])
def test_held_out_accuracy(frames, module, label, modulus, remainder, threshold, name):
    docs, labels = frames
    rows = module.score(docs, module.train(docs, labels)).collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) == set(docs.columns)
    assert all(0 <= r[name] <= 1 for r in rows)
    truth = {r[0]: r[label] for r in corpus()[1]}
    right = [(r[name] >= threshold) == bool(truth[r.doc_id]) for r in rows if r.doc_id is not None and r.doc_id < 240 and r.doc_id and held(r.doc_id, modulus, remainder)]
    assert sum(right) / len(right) >= 0.9
    twice = [r[name] for r in rows if r.doc_id == 903]
    assert len(twice) == 2 and twice[0] == twice[1]


@pytest.mark.parametrize("module, name", [(quality, "quality_score"), (toxicity, "toxicity")])
def test_degenerate_labels(frames, module, name):
    docs, labels = frames
    none = module.score(docs, module.train(docs, labels.limit(0)))
    assert {r[name] for r in none.collect()} == {0.5}
    column = "quality" if module is quality else "toxic"
    ones = labels.filter(f"{column} = 1")
    assert all(r[name] > 0.99 for r in module.score(docs, module.train(docs, ones)).collect())
    assert module.score(docs.limit(0), module.train(docs.limit(0), labels)).count() == 0


def test_keep_good(frames):
    docs, labels = frames
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {900, 901} <= ids and len([i for i in ids if i is not None and i < 240 and i % 4 == 0]) <= 3


def test_grams_of_long_texts_lose_nothing(monkeypatch):
    text = " ".join(str(i) for i in range(5000)).encode()
    whole = set(toxicity.distinct(text).tolist())
    monkeypatch.setattr(toxicity, "CHUNK", 500)
    assert whole <= set(toxicity.distinct(text).tolist())


def test_grams_are_of_characters():
    """Accented and wide characters count as one each, and a long text in pieces has the grams of the whole."""
    import numpy as np

    text = "Ünïcödé 漢字かな交じり文"
    points = toxicity.characters(text.encode())
    assert len(points) == len(text) + 2 and chr(points[1]) == "Ü"
    assert len(toxicity.grams(points)) == sum(len(points) - n + 1 for n in toxicity.SIZES)
    long = ("käse " * 70_000 + "ende").encode()
    whole = np.unique(toxicity.grams(toxicity.characters(long)))
    assert (toxicity.distinct(long) == whole).all() and len(toxicity.characters(long)) > toxicity.CHUNK


def test_repeated_ids_count_once_in_the_sample(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")], "doc_id long, text string")
    picked = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.2)], "doc_id long, y int, draw double")
    rows = labelled.with_texts(picked, docs).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, ""), (2, "c")]
