import random

import corpus_pipeline
from tarnwick.llm import near_copies as n


def corpus():
    """Groups of texts of which words were replaced, from short to long, so that similarities fall on both sides of 0.8."""
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(3000)]
    docs = []
    for g in range(70):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((6, 30, 60, 100, 300)))]
        for k in range(4):
            copy = list(words)
            for _ in range(k * len(words) // 90 or int(k > 0)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs) + 10, " ".join(copy).upper() if g % 2 else " ".join(copy)))
    docs += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c " * 9_000), (8, "a b c " * 8_000)]
    rng.shuffle(docs)
    return docs


def test_every_similarity_of_08_is_linked_and_no_other(spark):
    docs = corpus()
    want, pairs = n.brute_force([d for d in docs if (d[1] or "").strip()])
    want |= {1: 1, 2: 1, 3: 1}
    assert len(pairs) > 100
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in n.near_copies(frame).collect()} == want
    kept = corpus_pipeline.stage_near_dup(spark, frame, "")
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_one_replaced_word_of_a_hundred(spark):
    rng = random.Random(8)
    docs = []
    for i in range(0, 400, 2):
        words = [str(rng.random()) for _ in range(100)]
        docs += [(i, " ".join(words)), (i + 1, " ".join([*words[:50], "other", *words[51:]]))]
    kept = corpus_pipeline.stage_near_dup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 400, 2))


def test_empty_tables_and_null_ids(spark):
    frame = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (2, "a b c"), (3, "A b  c")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in n.keep_one(frame).collect()) == ["2", "None", "None"]
    assert n.keep_one(frame.limit(0)).count() == 0


def dense(groups, copies, seed=5):
    """Texts of 200 words that share all but a passage of 25; those of a group differ in a few words."""
    rng = random.Random(seed)
    base, docs = [f"b{i}" for i in range(200)], []
    for g in range(groups):
        words = [*base[:90], *(f"g{g}x{i}" for i in range(25)), *base[115:]]
        for _ in range(copies):
            copy = list(words)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(200)] = f"r{rng.random()}"
            docs.append((len(docs), " ".join(copy)))
    return docs


def test_dense_bands_without_representatives(spark, monkeypatch):
    # no pair has met and no link is known before, and a band falls into many blocks
    monkeypatch.setattr(n, "MET", 1)
    monkeypatch.setattr(n, "BLOCK", 7)
    docs = dense(20, 6)
    rows = n.materialise(n.sketches(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("row", n.F.col("doc_id")))
    keys = n.materialise(rows.select("row", "n", "bits_a", "bits_b", n.F.explode("bands").alias("key")))
    runs = n.materialise(keys.groupBy("key").agg(n.F.count("*").alias("size"), n.F.sum("n").alias("weight")))
    apart = n._apart(keys, runs, spark.createDataFrame([], "node long, root long"))
    assert apart.agg(n.F.max("parts")).first()[0] > 3
    links = n._crossing(apart, rows, 0.8)
    root = {r.node: r.root for r in n.components(links).collect()}
    want, pairs = n.brute_force(docs)
    assert len(set(want.values())) > 15 and {(r.a, r.b) if r.a < r.b else (r.b, r.a) for r in links.collect()} <= pairs
    assert {d: root.get(d, d) for d in want} == want


def test_dense_bands_against_brute_force(spark):
    docs = dense(60, 3)
    want, _ = n.brute_force(docs)
    assert {r.doc_id: r.component_id for r in n.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_signatures_share_a_key_where_a_segment_differs_in_one_minimum():
    low = n.minima(n.shingles(b"one two three four five six seven eight nine ten"))
    own = n.variants(low)
    assert len(set(own.tolist())) == n.SEGMENTS * n.LENGTH
    one, two = low.copy(), low.copy()
    one[::n.LENGTH] += n.np.uint64(1)
    two[::n.LENGTH] += n.np.uint64(1)
    two[1 :: n.LENGTH] += n.np.uint64(1)
    # of each segment that differs in one position the key without it is left, and none of one that differs in two
    assert n.np.flatnonzero(own == n.variants(one)).tolist() == list(range(0, n.SEGMENTS * n.LENGTH, n.LENGTH))
    assert not (own == n.variants(two)).any()


def test_sets_are_picked_without_a_shuffle_of_all_rows(spark, monkeypatch):
    """Sets of candidates come from the table of all rows by a bitmap, also where no side of a join is small enough to broadcast."""
    monkeypatch.setattr(n, "BLOCK", 8)
    plans, write = [], n.materialise

    def written(df, name):
        if name == "sets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(n, "materialise", written)
    docs = corpus()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.doc_id: r.component_id for r in n.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = n.brute_force([d for d in docs if (d[1] or "").strip()])[0]
    assert found == want | {1: 1, 2: 1, 3: 1}
    assert plans and not any("Exchange" in p for p in plans)


def test_rows_are_picked_by_their_ids(spark):
    rows = spark.range(0, 1 << 36, 1 << 20).select(n.F.col("id").alias("row"), n.F.lit("x").alias("hashes"))
    ids = spark.range(0, 1 << 36, 1 << 24).select(n.F.col("id").alias("row"))
    got = [r.row for r in n.among(rows, ids, "row").collect()]
    assert {r.row for r in ids.collect()} <= set(got) and len(got) == len(set(got)) < 4_500
    assert n.among(rows, ids.limit(0), "row").count() == 0
