from tarnwick.llm import decontaminate as d

ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "Short, item!"),
    (3, "Über straße 7 8 9 a b c d e f"),
    (4, None),
    (5, ""),
    (None, "this item has no id and takes no part at all in search"),
    (10, "a a a a a a a a a a a"),
    (1, "one two three four five six seven eight nine ten eleven twelve"),
]
DOCS = [
    (1, "zero ONE two three-four five six seven eight nine ten eleven thirteen"),
    (2, "nothing here " * 40),
    (3, None),
    (4, ""),
    (5, "x short item short item, y" + " a" * 25),
    (6, "this item has no id and takes no part at all in search"),
    (7, "und Über straße 7 8 9 a b c d e f g"),
    (8, "one two three four five six seven eight nine"),
    (8, "one two three four five six seven eight nine"),
    (9, ("lorem ipsum " * 5000) + "two three four five six seven eight nine ten eleven twelve"),
]


def frames(spark):
    docs = spark.createDataFrame([(a, b, 1) for a, b in DOCS], "doc_id long, text string, contamination int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def digest(rows):
    import hashlib

    return {r.doc_id: (r.f.n_words, r.f.n_hit, len(r.f["items"]), hashlib.sha256(",".join(r.f["items"]).encode()).hexdigest(), r.f.n_hit > 0) for r in rows}


def test_matches_brute_force(spark):
    docs, items = frames(spark)
    rows = d.find(docs, items, into="f").collect()
    assert len(rows) == len(DOCS)
    assert digest(rows) == d.brute_force(DOCS, ITEMS)


def test_shards_give_the_same(spark, monkeypatch):
    docs, items = frames(spark)
    monkeypatch.setattr(d, "SHARD_WINDOWS", 40)
    monkeypatch.setattr(d, "PIECE", 2)
    assert len(d.pattern_tables(items)) > 1
    assert digest(d.find(docs, items, into="f").collect()) == d.brute_force(DOCS, ITEMS)


def test_removes_and_keeps_columns(spark):
    docs, items = frames(spark)
    kept = d.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 8, 8]


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert d.find(docs.limit(0), items).count() == 0
    assert d.remove_contaminated(docs, items.limit(0)).count() == len(DOCS)
