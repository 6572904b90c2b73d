import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import shapes as g
from tarnwick.operators import areas

SQUARE = [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]
SHAPES = {
    1: {"type": "Polygon", "coordinates": SQUARE},
    2: {"type": "MultiPolygon", "coordinates": [SQUARE, [[[20, 20, 5], [22, 20, 5], [21, 23, 5]]]]},
    3: {"type": "LineString", "coordinates": [[-5, -5], [5, 5], [15, 0]]},
    4: {"type": "Point", "coordinates": [3, 3]},
    5: {"type": "MultiPoint", "coordinates": [[-3, 3], [30, 30]]},
    6: {"type": "MultiLineString", "coordinates": [[[0, 20], [5, 20]], [[40, 40], [41, 41]]]},
}
BROKEN = {7: None, 8: "{}", 9: "not json", 10: '{"type": "Polygon", "coordinates": []}', 11: '{"type": "Point", "coordinates": [1]}', 12: '{"type": "Circle", "coordinates": [1, 2]}'}


def parts(s):
    c = s["coordinates"]
    return {"Point": lambda: [[c]], "MultiPoint": lambda: [[p] for p in c], "LineString": lambda: [c], "Polygon": lambda: c, "MultiLineString": lambda: c, "MultiPolygon": lambda: [r for p in c for r in p]}[s["type"]]()


def km(s, x, y):
    """Winding by angles for the area, and small steps along the edges for the distance."""
    area = "Polygon" in s["type"]
    odd, best = 0, math.inf
    wide = g.DEGREE_KM * math.cos(math.radians(y))
    for r in parts(s):
        r = [*r, r[0]] if area else r if len(r) > 1 else [r[0], r[0]]
        turn = 0.0
        for (x1, y1, *_), (x2, y2, *_) in zip(r, r[1:]):
            d = math.atan2(y2 - y, x2 - x) - math.atan2(y1 - y, x1 - x)
            turn += (d + math.pi) % (2 * math.pi) - math.pi
            for k in range(2001):
                t = k / 2000
                best = min(best, math.hypot((x1 + t * (x2 - x1) - x) * wide, (y1 + t * (y2 - y1) - y) * g.DEGREE_KM))
        odd += area and abs(turn) > 1
    return 0.0 if odd % 2 else best


@pytest.fixture
def shapes(spark):
    rows = [(k, json.dumps(v)) for k, v in SHAPES.items()] + list(BROKEN.items())
    return spark.createDataFrame(rows, "id long, geometry string")


def test_points_within(spark, shapes):
    rng = random.Random(2)
    at = {i: (rng.uniform(-12, 45), rng.uniform(-12, 45)) for i in range(250)} | {900: (5.0, 5.0), 901: (2.0, 2.5)}
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in at.items()] + [(999, None, 1.0)], "p long, lon double, lat double")
    for reach in (0.0, 150.0):
        got = {(r.p, r.id): r.km for r in areas.points_within(points, shapes, "p", "id", "geometry", km=reach).collect()}
        for i, (x, y) in at.items():
            for k, s in SHAPES.items():
                d = km(s, x, y)
                if abs(d - reach) > 1 or d == 0:
                    assert ((i, k) in got) == (d <= reach), (i, k, d)
                if (i, k) in got:
                    assert abs(got[i, k] - d) < 1
        assert all(k in SHAPES for _, k in got) and got
    assert (900, 1) not in {(r.p, r.id) for r in areas.points_within(points, shapes, "p", "id", "geometry").collect()}


def test_no_shapes(spark, shapes):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "p long, lon double, lat double")
    assert areas.points_within(points, shapes.filter("id > 6"), "p", "id", "geometry").count() == 0


def test_boxes(shapes):
    ids = lambda *box: sorted(r.id for r in areas.in_box(shapes, "geometry", *box).collect())
    assert ids(4.5, 4.5, 5.5, 5.5) == [3]  # in the hole of both squares, on the line
    assert ids(1, 7, 2, 8) == [1, 2]
    assert ids(-20, -20, 60, 60) == [1, 2, 3, 4, 5, 6]
    assert ids(29, 29, 31, 31) == [5] and ids(100, 0, 110, 5) == []
    assert ids(12, 1.4, 12.5, 1.6) == [3] and ids(21.5, 22.5, 22, 23) == []
    assert ids(170, 2, -2, 4) == [5]  # across the antimeridian


def test_centre_and_reach(shapes):
    row = {r.id: r for r in shapes.filter("id < 7").select("id", g.centre(g.shape("geometry")).alias("c"), g.diagonal_km(g.shape("geometry")).alias("d"), g.reach_km(g.shape("geometry")).alias("r")).collect()}
    assert tuple(row[1].c) == (5.0, 5.0) and row[4].d == 0 and row[4].r == 150.0
    assert abs(row[1].d - math.hypot(10 * g.DEGREE_KM * math.cos(math.radians(5)), 10 * g.DEGREE_KM)) < 2 and row[1].r == 1.5 * row[1].d


def test_near_place(shapes):
    assert sorted(r.id for r in areas.near_place(shapes, "geometry", 5.0, 5.0, 130.0).collect()) == [1, 2, 3]


def test_distant_linked(spark, shapes):
    point = lambda x, y: json.dumps({"type": "Point", "coordinates": [x, y]})
    linked = spark.createDataFrame([(1, point(5, 5)), (1, point(40, 5)), (1, point(9, 9)), (1, None), (4, point(3, 3)), (4, point(3, 5)), (2, point(100, 0)), (2, point(-100, 0))], "id long, geometry string")
    assert sorted(map(tuple, areas.distant_linked(shapes, linked, "id", "geometry").collect())) == [(1, 1), (2, 2), (4, 1)]


def test_copies_of_points_and_shapes_are_tested_once(spark, shapes, monkeypatch):
    written = {}
    monkeypatch.setattr(areas, "materialise", lambda df, name="t", keep=areas.materialise: written.setdefault(name, keep(df, name)))
    copies = shapes.select(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("c"), "id", "geometry").selectExpr("id + 100 * c as id", "geometry")
    points = spark.createDataFrame([(i, *at) for i in range(30) for at in ((2.0, 2.5), (5.0, 5.0), (300.0, 0.0))], "p long, lon double, lat double")
    got = areas.points_within(points, copies, "p", "id", "geometry").collect()
    assert len(got) == 20 * 30 * 3  # (2, 2.5) lies in both squares, (5, 5) on the line
    assert {r.id % 100 for r in got} == {1, 2, 3} and all(r.km == 0 for r in got)
    assert written["shapes"].count() == 6 and written["met"].count() == 3


def test_distant_linked_of_a_group(spark, shapes):
    """What is linked to all places of a group is given once, and copies count as often as they stand."""
    point = lambda x, y: json.dumps({"type": "Point", "coordinates": [x, y]})
    places = shapes.select("id", (F.col("id") % 2).alias("grp"), "geometry").unionByName(shapes.filter("id = 1").selectExpr("101 as id", "1 as grp", "geometry"))
    linked = spark.createDataFrame([(1, point(5, 5)), (1, point(40, 5)), (1, point(40, 5)), (1, point(9, 9)), (1, None), (0, point(100, 0))], "grp long, geometry string")
    got = dict(map(tuple, areas.distant_linked(places, linked, "id", "geometry", by="grp").collect()))
    each = places.join(linked.withColumnRenamed("geometry", "g"), "grp").select("id", F.col("g").alias("geometry"))
    assert got == dict(map(tuple, areas.distant_linked(places, each, "id", "geometry").collect()))
    assert got[1] == got[101] == 2 and got[2] == got[4] == 1
