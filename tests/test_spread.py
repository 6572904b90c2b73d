"""Work that is dealt to more tasks as tables grow, with the results of before."""

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwick import queries, session
from tarnwick.operators import catalog
from tarnwick.operators import duplicates as d
from tarnwick.sources import outputs

queries.load()
SF = "/root/testdata/sf0.001"


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    dealt = session.spread(spark.range(100), "id")
    assert dealt.rdd.getNumPartitions() == 11 and dealt.count() == 100
    few = spark.range(30)
    assert session.spread(few, "id") is few


@pytest.mark.parametrize("name", ["auto_connections", "connections_in_order", "hub_counts"])
def test_dealt_queries_give_what_their_sql_gives(spark, monkeypatch, name):
    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    want = con.sql(f"select {', '.join(got.columns)} from rel").fetchall()
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_manifest_is_made_by_many_tasks(spark, monkeypatch, tmp_path):
    made = spark.range(8, numPartitions=8).select(F.spark_partition_id().cast("string").alias("file"))
    monkeypatch.setattr(outputs, "manifest", lambda *_: made)
    outputs.export_bundle({"t": spark.range(1)}, str(tmp_path))
    written = spark.read.json(f"{tmp_path}/manifest")
    assert written.select("file").distinct().count() == 8 and len(list((tmp_path / "manifest").glob("*.json"))) == 1


def test_a_long_key_is_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PART", 7)
    keys = {i: {"exact:all"} | {f"k{i % 5}"} | ({"exact:few"} if i < 4 else set()) for i in range(50)} | {60: {"k1"}, 61: {"alone"}, 62: {"k2", "k3"}}
    keyed = spark.createDataFrame([(i, k) for i, ks in keys.items() for k in [*ks, *ks]], "id long, key string")
    pairs, skipped = catalog.blocking_pairs(keyed, "id", cap=10)
    size = {k: sum(k in ks for ks in keys.values()) for k in set().union(*keys.values())}
    wide = {k: n for k, n in size.items() if n > 10 and not k.startswith("exact:")}
    want = sorted((a, b) for a, b in itertools.combinations(keys, 2) if (keys[a] & keys[b]) - set(wide))
    assert sorted(map(tuple, pairs.collect())) == want
    assert {x.key: x.size for x in skipped.collect()} == wide


def test_keys_of_one_person_join_nothing(spark):
    people = spark.createDataFrame([(1, "Ann Lee"), (2, "Ann Lee Jr"), (3, "Bob Poe"), (4, "Lee Ann")], "id long, label string")
    found = d.person_pairs(people)
    assert sorted((x.a, x.b) for x in found.collect()) == [(1, 4)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
