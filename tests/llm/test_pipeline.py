import random

import corpus_pipeline
from tarnwick.llm import decontaminate, mixing, near_copies, substring_dup


def write(spark, folder):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item, passage = text(30), text(60)
    docs = [(i, text(rng.randint(60, 200)), "en", f"s{i % 3}", 5) for i in range(100)]
    docs += [(200 + i, text(80).upper().replace(" ", "!! "), "en", "s0", 5) for i in range(30)]
    docs += [(300, docs[3][1], "en", "s1", 5), (301, docs[4][1] + " extra", "en", "s1", 5)]
    docs += [(310 + i, f"{text(80)} {passage} {text(70)}", "en", "s2", 5) for i in range(4)]
    docs += [(320, f"{text(60)} {item} {text(60)}", "fr", "s2", 5), (330, None, None, None, None), (331, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in docs[:130]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_against_brute_force(spark, tmp_path):
    docs = write(spark, str(tmp_path))
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    good = corpus_pipeline.stage_quality(spark, frame, str(tmp_path)).cache()
    assert good.columns == frame.columns
    ids = {d for d, _ in rows(good)}
    assert ids == {d[0] for d in docs if not 200 <= d[0] < 300}
    one = corpus_pipeline.stage_near_dup(spark, good, str(tmp_path)).cache()
    assert one.columns == frame.columns and {d for d, _ in rows(one)} == set(near_copies.brute_force(rows(good))[0].values())
    assert {300, 301}.isdisjoint({d for d, _ in rows(one)})
    cut = corpus_pipeline.stage_substring_dup(spark, one, str(tmp_path)).cache()
    want = substring_dup.brute_force(rows(one))
    assert cut.columns == frame.columns and {d: len((t or "").split()) for d, t in rows(cut)} == {d: n - gone for d, (n, gone, _) in want.items() if not n or n > gone}
    clean = corpus_pipeline.stage_decontaminate(spark, cut, str(tmp_path)).cache()
    found = decontaminate.brute_force(rows(cut), [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()])
    assert clean.columns == frame.columns and {d for d, _ in rows(clean)} == {d for d, x in found.items() if not x[-1]} and 320 not in {d for d, _ in rows(clean)}
    mixed = corpus_pipeline.stage_mixture(spark, clean, str(tmp_path))
    assert mixed.columns == [*frame.columns, "mix_copies", "mix_weight", "mix_order"]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, mixed.collect())) == sorted(map(str, whole))
    assert len({r.source for r in whole}) == 3 and all(1 <= r.mix_copies <= mixing.MAX_REPETITION + 1 for r in whole)


def test_empty_tables_stay_empty(spark, tmp_path):
    write(spark, f"{tmp_path}/full")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
