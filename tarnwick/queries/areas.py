"""Queries of areas: triangles at suppliers and points at customers, derived from keys, the same way in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import shapes as g
from tarnwick.operators import areas
from tarnwick.queries import query
from tarnwick.session import table

# corners a, b, c of a supplier's triangle; a point lies in it if it is on one side of all edges
_T = "(select s_suppkey, s_nationkey, cast(s_suppkey * 37 % 350 - 178 as double) as ax, cast(s_suppkey * 17 % 150 - 78 as double) as ay, s_suppkey % 5 + 2.0 as w from supplier)"
_TRIANGLES = f"(select *, ax + w as bx, ay + 1.0 as by_, ax + 2.0 as cx, ay + w as cy from {_T})"
_POINTS = "(select c_custkey, cast(c_custkey * 53 % 360 - 180 + 0.3 as double) as lon, cast(c_custkey * 29 % 160 - 80 + 0.4 as double) as lat from customer)"
_SIDE = "({2} - {0}) * (lat - {1}) - ({3} - {1}) * (lon - {0})"
_IN = " and ".join("(" + _SIDE.format(*e.split()) + ") > 0" for e in ("ax ay bx by_", "bx by_ cx cy", "cx cy ax ay"))


def _edge(x1: str, y1: str, x2: str, y2: str) -> str:
    k, wide = g.DEGREE_KM, f"{g.DEGREE_KM} * cos(radians(lat))"
    px, py, dx, dy = f"(({x1} - lon) * {wide})", f"(({y1} - lat) * {k})", f"(({x2} - {x1}) * {wide})", f"(({y2} - {y1}) * {k})"
    along = f"greatest(0.0, least(1.0, -({px} * {dx} + {py} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(pow({px} + {along} * {dx}, 2) + pow({py} + {along} * {dy}, 2))"


_KM = f"case when {_IN} then 0.0 else least({_edge('ax', 'ay', 'bx', 'by_')}, {_edge('bx', 'by_', 'cx', 'cy')}, {_edge('cx', 'cy', 'ax', 'ay')}) end"


def triangles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    x, y, w = F.col("s_suppkey") * 37 % 350 - 178, F.col("s_suppkey") * 17 % 150 - 78, F.col("s_suppkey") % 5 + 2.0
    corner = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    ring = F.array(corner(x, y), corner(x + w, y + 1.0), corner(x + 2.0, y + w), corner(x, y))
    return s.select("s_suppkey", "s_nationkey", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geometry"))


def points(spark, sf_dir, *further):
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", *further, (c * 53 % 360 - 180 + 0.3).cast("double").alias("lon"), (c * 29 % 160 - 80 + 0.4).cast("double").alias("lat"))


@query(f"select c_custkey, s_suppkey from {_TRIANGLES}, {_POINTS} where {_IN}")
def points_in_polygons(spark, sf_dir):
    return areas.points_within(points(spark, sf_dir), triangles(spark, sf_dir), "c_custkey", "s_suppkey", "geometry").select("c_custkey", "s_suppkey")


@query(f"select c_custkey, s_suppkey, round(km, 4) as km from (select c_custkey, s_suppkey, {_KM} as km from {_TRIANGLES}, {_POINTS}) where km <= 120")
def points_near_polygons(spark, sf_dir):
    found = areas.points_within(points(spark, sf_dir), triangles(spark, sf_dir), "c_custkey", "s_suppkey", "geometry", km=120.0)
    return found.select("c_custkey", "s_suppkey", F.round("km", 4).alias("km"))


@query(f"select s_suppkey, round(km, 4) as km from (select s_suppkey, {_KM} as km from {_TRIANGLES}, (select 20.3 as lon, 30.4 as lat)) where km <= 900")
def polygons_near_place(spark, sf_dir):
    return areas.near_place(triangles(spark, sf_dir), "geometry", 20.3, 30.4, 900.0).select("s_suppkey", F.round("km", 4).alias("km"))


def _hav(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({y2} - ({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - ({x1})) / 2), 2))))"


@query(
    f"with t as (select *, ax as west, ay as south, greatest(bx, cx) as east, greatest(by_, cy) as north from {_TRIANGLES}), c as (select *, (west + east) / 2 as mx, (south + north) / 2 as my from t),"
    f" r as (select *, greatest(150.0, 1.5 * sqrt(pow({_hav('west', 'my', 'east', 'my')}, 2) + pow({_hav('west', 'south', 'west', 'north')}, 2))) as reach from c)"
    f" select s_suppkey, count(*) as distant from r join (select c_nationkey, c_custkey * 53 % 360 - 180 + 0.3 as lon, c_custkey * 29 % 160 - 80 + 0.4 as lat from customer) on c_nationkey = s_nationkey where {_hav('mx', 'my', 'lon', 'lat')} > reach and not ({_IN}) group by 1"
)
def distant_linked_counts(spark, sf_dir):
    """Of every supplier's area how many customers of its nation lie beyond its reach."""
    at = points(spark, sf_dir, "c_nationkey").withColumnRenamed("c_nationkey", "s_nationkey")
    linked = at.select("s_nationkey", F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))).alias("geometry"))
    return areas.distant_linked(triangles(spark, sf_dir), linked, "s_suppkey", "geometry", by="s_nationkey")
