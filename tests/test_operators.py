"""Operators on small rows seeded by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import geo, search, text, vectors
from tarnwick.operators import articles as a
from tarnwick.operators import catalog as c
from tarnwick.operators import ingest as i
from tarnwick.operators import mentions as m
from tarnwick.operators import operations as o
from tarnwick.operators import resolution as r
from tarnwick.operators.graph import components


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, text.normalize_text("a"), a="  O’Neil \t the  THIRD ") == "o'neil the third"
    assert one(spark, text.fold_key("a"), a="Ångström Café") == "angstrom cafe"
    assert one(spark, text.normalize_text("a"), a=None) is None
    assert one(spark, text.trigram_similarity("a", "b"), a="word", b="word") == 1.0
    assert one(spark, text.trigram_similarity("a", "b"), a="word", b="two words") == pytest.approx(4 / 11)
    assert one(spark, text.trigram_similarity("a", "b"), a="", b="word") == 0.0
    assert one(spark, text.acronym("a"), a="Bureau of the Public Works") == "BPW"
    assert one(spark, text.acronym("a"), a="Works") is None
    assert tuple(one(spark, text.name_parts("a"), a="Ludwig van Beethoven, Jr.")) == ("ludwig", "van beethoven")
    assert tuple(one(spark, text.name_parts("a"), a="")) == (None, None)
    assert [one(spark, text.name_overlap("a", "b"), a=x, b=y) for x, y in [("Ann Lee", "ann  lee"), ("Ann Lee", "Bob Lee"), ("Ann Lee", "Ann Poe"), ("Ann Lee", "Max Poe")]] == [100, 50, 25, 0]
    assert one(spark, text.preview("a", 5), a=" abcdef ") == "abcd…" and one(spark, text.preview("a", 6), a=" abcdef ") == "abcdef"
    assert one(spark, text.outlet_host("a"), a="https://WWW.Example.org:8080/x") == "example.org"
    assert tuple(one(spark, text.read_cursor(text.cursor("a", "b")), a=12345, b=1700000000)) == (12345, 1700000000)
    assert tuple(one(spark, text.read_cursor("a"), a="no cursor!")) == (None, None)
    same = text.fingerprint(name=F.col("a"), other=F.lit(" "))
    assert one(spark, same, a="x") == one(spark, text.fingerprint(name=F.col("a")), a="x")
    assert one(spark, text.snippet("a", "b", 2), a="abcdefg", b="D") == "bcdef"


def test_search_language(spark):
    hit = lambda q, t: one(spark, search.web_search(q, F.col("t")), t=t)
    assert hit("fire city", "City hall on fire") and not hit("fire city", "City hall")
    assert hit('"city hall"', "The City  Hall!") and not hit('"hall city"', "The City Hall")
    assert hit("a OR b", "b") and hit("x a OR b", "x b") and not hit("x a OR b", "b") and hit("a -b", "a c") and not hit("a -b", "a b") and hit("", "anything")
    assert search.clause("!size:gte:10") == (True, "size", "gte", [10.0]) and search.clause("flag:true") == (False, "flag", "eq", [True]) and search.clause("k")[2] == "exists"
    assert search.clause("k:a|b")[3] == ["a", "b"]
    with pytest.raises(ValueError):
        search.clause("k:lt:1|2")


def test_geo(spark):
    assert one(spark, geo.haversine("a", "b", -87.63, 41.8785), a=-87.6298, b=41.8781) == pytest.approx(0.0474, abs=1e-3)
    assert one(spark, geo.haversine("a", "b", 180.0, 0.0), a=0.0, b=0.0) == pytest.approx(math.pi * geo.EARTH_KM)
    assert one(spark, geo.near("a", "b", 179.9, 0.0, 50.0), a=-179.9, b=0.0) and not one(spark, geo.near("a", "b", 179.9, 0.0, 20.0), a=-179.9, b=0.0)
    assert one(spark, geo.near("a", "b", 0.0, 89.9, 50.0), a=180.0, b=89.9)
    assert one(spark, geo.cell("a", "b", 3), a=180.0, b=90.0) == "333" and one(spark, geo.parent("a", 2), a="3") is None
    assert tuple(one(spark, geo.geojson_box("a"), a='{"type":"Polygon","coordinates":[[[0,1],[4,1],[4,-3.5],[0,1]]]}')) == (0.0, -3.5, 4.0, 1.0)


def test_vectors(spark):
    cos = lambda x, y: spark.createDataFrame([(x, y)], "a array<double>, b array<double>").select(vectors.cosine("a", "b")).first()[0]
    assert cos([1.0, 0.0], [1.0, 1.0]) == pytest.approx(2**-0.5) and cos([1.0], [1.0, 2.0]) == 0.0 and cos([], []) == 0.0 and cos([0.0], [1.0]) == 0.0


def test_metadata_clauses_and_attributes(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "id long")
    meta = spark.createDataFrame([(0, "topic", "a"), (1, "topic", "b"), (1, "format", "n"), (2, "format", "n")], "id long, meta_type string, category string")
    ids = lambda d: sorted(x.id for x in d.collect())
    assert ids(a.meta_clauses(df, meta, "id", [(False, "topic", ["a", "b"])])) == [0, 1]
    assert ids(a.meta_clauses(df, meta, "id", [(True, "topic", [])])) == [2, 3, 4]
    assert ids(a.meta_clauses(df, meta, "id", [(False, "topic", []), (False, "format", ["n"])])) == [1] and ids(a.meta_clauses(df, meta, "id", [])) == [0, 1, 2, 3, 4]
    rows = spark.createDataFrame([(0, "size", None, 5.0, None), (1, "size", None, 9.0, None), (2, "on", None, None, True), (3, "kind", "Big", None, None)], "id long, name string, value_text string, value_number double, value_boolean boolean")
    assert ids(a.attribute_clauses(df, rows, "id", ["size:gt:5"])) == [1] and ids(a.attribute_clauses(df, rows, "id", ["!size:eq:5"])) == [1, 2, 3, 4]
    assert ids(a.attribute_clauses(df, rows, "id", ["size:neq:5"])) == [1] and ids(a.attribute_clauses(df, rows, "id", ["on:true"])) == [2] and ids(a.attribute_clauses(df, rows, "id", ["kind:ieq:big|small"])) == [3]


def test_near_pairs_lose_none(spark):
    import itertools
    import random

    rng = random.Random(1)
    names = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(3, 9))).strip() for _ in range(120)} - {""})
    grams = lambda s: {("  " + w + " ")[k : k + 3] for w in s.split() for k in range(len(w) + 1)}
    want = {(x, y) for x, y in itertools.combinations(names, 2) if len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= 0.5}
    got = c.near_pairs(spark.createDataFrame([(n,) for n in names], "label string"), "label", F.lit(1), 0.5)
    assert {(x.a, x.b) for x in got.collect()} == want


def test_blocks_dismissals_and_clusters(spark):
    keyed = spark.createDataFrame([(k, "wide") for k in range(6)] + [(0, "exact:x"), (1, "exact:x"), (1, "n"), (2, "n"), (8, "alone")], "id long, key string")
    pairs, skipped = c.blocking_pairs(keyed, "id", cap=4)
    assert sorted((x.a, x.b) for x in pairs.collect()) == [(0, 1), (1, 2)] and [(x.key, x.size) for x in skipped.collect()] == [("wide", 6)]
    left = c.without_dismissed(pairs, spark.createDataFrame([("1|2",)], "pair_key string"))
    assert {x.node: x.root for x in components(left).collect()} == {0: 0, 1: 0}


def test_first_occurrence_and_hub(spark):
    occ = spark.createDataFrame([(1, 1, None, False), (1, 2, 3, False), (1, 3, 1, True), (2, 4, None, False), (3, 5, 1, True)], "mention long, id long, place int, suppressed boolean")
    got = m.first_occurrence(occ, "mention", [F.asc_nulls_last("place"), F.col("id")])
    assert {x.mention: x.id for x in got.collect()} == {1: 2, 2: 4}
    hub = m.hub(spark.createDataFrame([(1,), (2,)], "article long"), spark.createDataFrame([(1, 7, True, "p"), (1, 7, True, "p"), (1, 8, False, "p")], "article long, entity long, active boolean, kind string"), ["p"])
    assert {x.article: (x.p_mentions, x.p_entities) for x in hub.collect()} == {1: (2, 1), 2: (0, 0)}


def test_upsert_identity_overlay(spark):
    old = spark.createDataFrame([(1, "a", "u"), (2, "b", "v"), (3, "c", None)], "id long, t string, url string")
    new = spark.createDataFrame([(1, None, None), (2, "b", None), (4, "d", "w")], "id long, t string, url string")
    got = {x.id: (x.t, x.url, x.action) for x in i.upsert(old, new, "id", ["t"], ["url"]).collect()}
    assert got == {1: (None, "u", "changed"), 2: ("b", "v", "unchanged"), 3: ("c", None, "kept"), 4: ("d", "w", "inserted")}
    base = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, t string")
    edits = spark.createDataFrame([(1, "edit", None), (2, "edit", "Y"), (3, "remove", None), (9, "add", "n")], "id long, op string, t string")
    assert {x.id: x.t for x in i.overlay(base, edits, "id", ["t"]).collect()} == {1: "x", 2: "Y", 9: "n"}
    batch = spark.createDataFrame([(1, "s", 5, "u9"), (2, None, None, "u2"), (3, None, None, None)], "row long, s string, e int, url string")
    stored = spark.createDataFrame([(10, "s", 5, "u2"), (11, "q", 6, "u9")], "sid long, s string, e int, url string")
    assert {x.row: (x.matched_id, x.rule) for x in i.identify(batch, stored, "row", "sid", [["s", "e"], ["url"]]).collect()} == {1: (10, 0), 2: (10, 1), 3: (None, None)}


def test_chunks_partition_the_text(spark):
    df = spark.createDataFrame([(1, "x" * 95), (2, ""), (3, "short")], "id long, t string")
    got = i.chunks(df, "t", target=10, overlap=2).orderBy("id", "chunk").collect()
    assert [(x.own_start, x.own_end, x.start, x.end) for x in got if x.id == 1] == [(0, 40, 0, 48), (40, 80, 32, 88), (80, 95, 72, 95)]
    assert [(x.id, x.chunk_text) for x in got if x.id != 1] == [(2, ""), (3, "short")]


def test_spans(spark):
    df = spark.createDataFrame([("Ann saw ann, not Hann. ANN", "Ann")], "t string, n string")
    assert sorted((x.start, x.end) for x in i.spans(df, "t", "n").collect()) == [(0, 3), (8, 11), (23, 26)]


def test_decisions(spark):
    names = spark.createDataFrame([(k, k == 1, k != 6) for k in range(1, 9)], "id long, private boolean, materializable boolean")
    cand = [
        (1, 9, 1.0, 1.0, True, True, 1),  # private
        (2, 9, 0.5, 0.5, True, True, 1),  # one exact
        (3, 9, 1.0, 1.0, True, True, 1), (3, 8, 1.0, 1.0, True, True, 2),  # two exact
        (4, 9, 0.95, 0.95, False, True, 1),  # clear
        (5, 9, 0.95, 0.95, False, True, 1), (5, 8, 0.95, 0.95, False, True, 2),  # two clear
        (7, 9, 0.279, 0.8, False, True, 1),  # held down by a gate
        (8, 9, 0.6, 0.6, False, False, 1),  # only a denied type
    ]
    df = spark.createDataFrame(cand, "id long, canonical long, score double, raw double, exact boolean, allowed boolean, recall_rank int")
    got = {x.id: (x.decision, x.canonical) for x in r.decide(df, names, "id").collect()}
    assert got == {1: ("DEFER", None), 2: ("LINK", 9), 3: ("DEFER", None), 4: ("LINK", 9), 5: ("DEFER", None), 6: ("DEFER", None), 7: ("DEFER", None), 8: ("MATERIALIZE", None)}


def test_deliveries(spark):
    assert [one(spark, o.outcome(F.col("a"), F.col("b")), a=x, b=y) for x, y in [(204, 0), (404, 0), (429, 0), (500, 10), (500, 90_000)]] == ["delivered", "failed", "retry", "retry", "failed"]
    waits = [one(spark, o.backoff(F.col("a"), F.lit("k")), a=k) for k in (1, 2, 9)]
    assert 24 <= waits[0] <= 36 and waits[1] == pytest.approx(2 * waits[0]) and 2880 <= waits[2] <= 4320
    assert one(spark, o.backoff(F.col("a"), F.lit("k"), F.lit(5000)), a=1) == 5000


def test_scratch_tables_can_be_cleared(spark):
    from tarnwick.session import clear_scratch, materialise

    kept = materialise(spark.range(3), "x")
    assert kept.count() == 3 and clear_scratch(spark) >= 1 and clear_scratch(spark) == 0


def test_attribute_clauses_have_limits(spark):
    """A clause too many is an error, for leaving it out would widen the result."""
    import pytest

    from tarnwick.functions import search
    from tarnwick.operators import articles

    frame = spark.createDataFrame([(1, "k0", "x", None, None)], "id long, name string, value_text string, value_number double, value_boolean boolean")
    assert articles.attribute_clauses(frame, frame, "id", ["k0:x"] * 25).count() == 1
    with pytest.raises(ValueError):
        articles.attribute_clauses(frame, frame, "id", ["k0:x"] * 26)
    assert len(search.clause("k:eq:" + "|".join(map(str, range(50))))[3]) == 50
    with pytest.raises(ValueError):
        search.clause("k:eq:" + "|".join(map(str, range(51))))


def test_geometry_texts(spark):
    from tarnwick.functions import geo

    shapes = [
        '{"type":"LineString","coordinates":[[10,50,300],[11,51,310]]}',
        '{"type":"MultiPoint","coordinates":[[1.5,2],[-3e1,4]]}',
        '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[0.2,0.2],[0.3,0.2],[0.3,0.3]]]}',
        '{"type":"LineString","coordinates":[[1,2]]}',
        '{"type":"LineString","coordinates":[[1,2],[3]]}',
    ]
    rows = spark.createDataFrame(list(enumerate(shapes)), "id long, g string").select("id", geo.geojson_box("g").alias("b"), geo.geojson_wkt("g").alias("w")).orderBy("id").collect()
    assert tuple(rows[0].b) == (10.0, 50.0, 11.0, 51.0) and tuple(rows[1].b) == (-30.0, 2.0, 1.5, 4.0)
    assert [r.w for r in rows] == [
        "LINESTRING (10.0 50.0, 11.0 51.0)",
        "MULTIPOINT ((1.5 2.0), (-30.0 4.0))",
        "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0), (0.2 0.2, 0.3 0.2, 0.3 0.3, 0.2 0.2))",
        None,
        None,
    ]


def test_source_files(spark):
    from tarnwick.sources import documents

    paths = ["in/2024-03-05/a-story-abcdefghij-0123456789.json", "a-abcdefghij-0123456789-output.json", "plain.json", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "id long, p string").select("id", documents.source_file_parts("p").alias("x")).orderBy("id").collect()
    assert [tuple(r.x) for r in rows] == [("2024-03-05", "abcdefghij", "0123456789"), (None, None, "0123456789"), (None, None, None), (None, None, None)]


def test_resolved_parameters():
    assert a.resolved({"section": " Sports "}) == {"section": None, "sort": "pub_date", "direction": "desc", "meta_type": "topic", "meta_category": "Sports"}
    assert a.resolved({"q": "x", "meta_type": "tag"})["sort"] == "relevance" and a.resolved({"q": "x", "sort": "pub_date"})["sort"] == "pub_date"


def test_canonical_list_by_alias_and_project(spark):
    canonicals = spark.createDataFrame([(1, "City Hall", "x"), (2, "Museum", "x"), (3, "100% Hall", "y")], "id long, label string, kind string")
    aliases = spark.createDataFrame([(2, "The HALL of art"), (2, "Hall 2")], "canonical long, alias string")
    mentions = spark.createDataFrame([(1, "n", 1), (1, "n", 2), (2, "m", 1), (2, None, 1)], "canonical long, nature string, project long")
    ids = lambda **k: sorted(r.id for r in a.canonical_list(canonicals, aliases, mentions, **k).collect())
    assert ids(part="hall") == [1, 2, 3] and ids(part="% h") == [3] and ids(part="hall", kind="x", natures=["m"]) == [2]
    assert ids(least=2) == [1, 2] and ids(least=2, projects=[1]) == [2] and ids() == [1, 2, 3]


def test_first_seen(spark):
    rows = spark.createDataFrame([("g", "b", 2), ("g", "a", 3), ("g", "b", 1), ("g", None, 0), ("h", "a", 9)], "k string, v string, n long")
    assert sorted((r.k, r.place, r.v) for r in a.first_seen(rows, ["k"], "v", ["n"]).collect()) == [("g", 1, "b"), ("g", 2, "a"), ("h", 1, "a")]


def test_persists(spark):
    stored = spark.createDataFrame([(1, "old", 0.5, True), (2, "old", 0.5, False), (3, "old", 0.5, None), (4, "old", None, False)], "k long, value string, confidence double, edited boolean")
    batch = spark.createDataFrame([(1, "new", 0.9), (2, "low", 0.1), (2, "new", 0.9), (4, "old", None), (5, "new", None)], "k long, value string, confidence double")
    got = lambda p: {r.k: (r.value, r.action) for r in i.persist_values(stored, batch, ["k"], p).collect()}
    assert got("smart_merge") == {1: ("old", "skipped"), 2: ("new", "changed"), 3: ("old", "kept"), 4: ("old", "unchanged"), 5: ("new", "inserted")}
    assert got("add_only")[2] == ("old", "skipped") and got("replace")[1] == ("new", "changed")
    with pytest.raises(ValueError):
        i.persist_values(stored, batch, ["k"], "other")
    sets = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "k long, n long, v string")
    new = spark.createDataFrame([(1, 0, "z"), (1, 0, "y"), (3, 0, "d")], "k long, n long, v string")
    rows = lambda p: sorted(tuple(r) for r in i.persist_sets(sets, new, ["k"], "n", p).collect())
    assert rows("replace") == [(1, 0, "y"), (2, 0, "c"), (3, 0, "d")]
    assert rows("add_only") == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")]


def test_ordinals(spark):
    from tarnwick.operators import runs

    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "id").repartition(7)
    got = runs.ordinals(rows, [F.desc("k")]).collect()
    assert len(got) == 1000 and all(r.ordinal == 1000 - r.k for r in got)


def test_questionable_people(spark):
    people = spark.createDataFrame([(1, "Anna Smith", None), (2, "acme  co", "business_professional"), (3, "WBEZ", None), (4, "Health", "x"), (5, None, "x"), (6, "Grouper Banks", None)], "id long, label string, kind string")
    organizations = spark.createDataFrame([("ACME Co", "Company")], "label string, kind string")
    got = {r.id: (r.score, r.confidence, r.suggested) for r in c.questionable_people(people, organizations).collect()}
    assert got == {2: (8, "high", "organization"), 3: (5, "medium", "unknown"), 4: (4, "medium", "organization")}


def test_blocks_are_never_broadcast(spark):
    """However small the file of the keyed rows is: dealt to parts they are many, and the driver would hold them all."""
    keyed = spark.range(3000).selectExpr("id", "'exact:' || id % 2 as key")
    pairs = c.blocking_pairs(keyed, "id")[0]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "REPARTITION_BY_NUM" in plan
    assert pairs.count() == 2 * 1500 * 1499 // 2


def test_dismissals_are_those_of_the_text(spark):
    pairs = spark.createDataFrame([(1, 2), (9, 10), (10, 9), (3, 4), (-5, 6)], "a long, b long")
    dismissed = spark.createDataFrame([("1|2",), ("10|9",), ("03|4",), ("4|3",), ("-5|6",), ("5",), ("x|y",), (None,), ("1|2",), ("1|2|3",)], "pair_key string")
    assert sorted(map(tuple, c.without_dismissed(pairs, dismissed).collect())) == [(3, 4, "3|4")]
    texts = lambda df: df.select(F.col("a").cast("string"), F.col("b").cast("string"))
    assert sorted(map(tuple, c.without_dismissed(texts(pairs), dismissed).select("a", "b", "pair_key").collect())) == [("3", "4", "3|4")]
