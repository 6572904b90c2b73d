import json

import pytest
from pyspark.sql import functions as F

from tarnwick.plans import flow
from tarnwick.queries import flows
from tarnwick.sources import documents, outputs
from tarnwick.streaming import events as stream


def test_order_and_cycles():
    f = flow.Flow({n: ("k", {}) for n in "abcd"}, [("a", "c"), ("b", "c"), ("c", "d")])
    assert f.order().index("c") > max(f.order().index("a"), f.order().index("b")) and f.order()[-1] == "d"
    with pytest.raises(ValueError):
        flow.Flow({n: ("k", {}) for n in "ab"}, [("a", "b"), ("b", "a")]).order()
    with pytest.raises(ValueError):
        flow.Flow({"a": ("k", {})}, [("a", "x")]).order()


def test_text_flow(spark):
    f = flow.Flow({"in": ("text_input", {"text": "Ann Lee met Bob Poe. Ann Lee left."}), "n": ("extract", {"into": "names", "several": True}), "out": ("output", {})}, [("in", "n"), ("n", "out")])
    row = f.frames(flow.steps(spark, ""))["out"].first()
    assert json.loads(row.result) == {"names": 3, "different_names": 2}


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"text": " x "}\n{"body": "y"}\n{"text": ""}\n{oops\n')
    (tmp_path / "b.txt").write_text("no document")
    got = documents.json_documents(spark, f"file://{tmp_path}").collect()
    assert sorted((r.text or "", r.problem or "") for r in got) == [("", "no text"), ("", "not json"), ("x", ""), ("y", "")]


def test_bundle_damage(spark, tmp_path):
    path = f"{tmp_path}/bundle"
    outputs.export_bundle({"t": spark.range(4500).coalesce(1)}, f"file://{path}")
    assert sorted(r.rows for r in spark.read.json(f"file://{path}/manifest").collect()) == [500, 2000, 2000]
    assert outputs.damaged(spark, f"file://{path}", ["t"]).count() == 0
    file = next((tmp_path / "bundle/t").glob("*.json"))
    file.write_text(file.read_text() + '{"id": 1}\n')
    for crc in (tmp_path / "bundle/t").glob(".*.crc"):
        crc.unlink()
    assert outputs.damaged(spark, f"file://{path}", ["t"]).count() == 1


def test_remapped_references(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "ref long, t string")
    ids = documents.fresh_ids(spark.createDataFrame([(1,)], "k long"), F.col("k"), "n")
    got = {r.t: r.ref for r in documents.remapped(rows, ids, "ref").collect()}
    assert len(got["a"]) == 32 and got["b"] is None and got["c"] is None


def test_merge_runs_again_after_a_failure(spark, tmp_path):
    merge = stream.merge_each(f"file://{tmp_path}/t", "k", ["v"])
    batch = lambda rows: spark.createDataFrame(rows, "event_id long, k string, v string")
    merge(batch([(1, "a", "1"), (2, "a", "2"), (3, "b", "3")]), 0)
    for _ in range(2):
        merge(batch([(4, "b", "4"), (5, "c", "5")]), 1)
    assert {r.k: r.v for r in spark.read.parquet(f"file://{tmp_path}/t/v1").collect()} == {"a": "2", "b": "4", "c": "5"}
    # a row older than the stored one changes nothing, and only the last two versions stay
    merge(batch([(2, "b", "2"), (6, "a", "6")]), 2)
    assert {r.k: r.v for r in spark.read.parquet(f"file://{tmp_path}/t/v2").collect()} == {"a": "6", "b": "4", "c": "5"}
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v1", "v2"]


@pytest.mark.parametrize("rows_a_task", [500_000, 100])
def test_arrivals_are_four_micro_batches_however_many_files(spark, tmp_path, monkeypatch, rows_a_task):
    monkeypatch.setattr(flows, "ROWS_A_TASK", rows_a_task)
    rows = spark.range(2000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 7 as user_id")
    rows.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    q = flows._arrivals(spark, str(tmp_path)).writeStream.foreachBatch(lambda df, n: seen.append(df.count()))
    q.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(seen) == 2000 and all(n > 300 for n in seen)
