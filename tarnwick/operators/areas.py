"""Searches by area over shapes: points with the shapes that hold them, shapes near a place or in a box, distant linked places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import shapes as g
from tarnwick.functions.geo import haversine
from tarnwick.session import materialise

#: The finest level of cells: each halves both axes.
FINEST = 12
#: What a box is widened by, in degrees, for the rounding of its sides.
SLIP = 1e-9


def _cell(value, low: float, width: float, side):
    return F.greatest(F.lit(0), F.least(side - 1, F.floor((value - low) / width * side))).cast("long")


def points_within(points: DataFrame, shapes: DataFrame, point: str, key: str, geometry: str, *, lon: str = "lon", lat: str = "lat", km: float = 0.0) -> DataFrame:
    """(point, key, km): the points within `km` of a shape, with their distance from it.

    Equal geometries are one shape and points of equal coordinates one spot, so that copies are tested once and met again in the result.
    A shape is covered by a few cells of a level that suits its box; a spot is in one cell of each level in use, 13 at most. So
    the pairs that are tested meet by an equality join, which Spark can split where a cell is busy; the box is asked before the edges are.
    Null and broken geometry meets nothing.
    """
    # written once: a shape is read from its text once, and levels and cells come from the same
    texts = shapes.select(F.col(geometry).alias("__g")).filter("__g is not null").distinct()
    known = materialise(texts.withColumn("__id", F.monotonically_increasing_id()).withColumn("s", g.shape("__g")).filter("s is not null"), "shapes")
    members = materialise(shapes.select(key, F.col(geometry).alias("__g")).join(known.select("__g", "__id"), "__g").select(key, "__id"), "members")
    s = known.select("__id", "s")
    high = F.lit(km / g.DEGREE_KM)
    widest = F.least(F.greatest(F.abs(F.col("s.south") - high), F.abs(F.col("s.north") + high)), F.lit(89.0))
    wide = F.when(F.lit(km) > 0, high / F.cos(F.radians(widest))).otherwise(0.0)
    # near a pole, or across the antimeridian, a reach takes in the whole parallel
    around = (F.col("s.west") - wide < -180) | (F.col("s.east") + wide > 180)
    west, east = F.when(around, -180.0).otherwise(F.col("s.west") - wide), F.when(around, 180.0).otherwise(F.col("s.east") + wide)
    s = s.select("__id", "s", west.alias("w"), east.alias("e"), (F.col("s.south") - high).alias("b"), (F.col("s.north") + high).alias("t"))
    fit = F.least(F.lit(360.0) / F.greatest(F.col("e") - F.col("w"), F.lit(1e-9)), F.lit(180.0) / F.greatest(F.col("t") - F.col("b"), F.lit(1e-9)))
    s = s.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(fit)))).cast("int"))
    side = F.expr("shiftleft(1L, level)")
    xs = F.sequence(_cell(F.col("w"), -180.0, 360.0, side), _cell(F.col("e"), -180.0, 360.0, side))
    ys = F.sequence(_cell(F.col("b"), -90.0, 180.0, side), _cell(F.col("t"), -90.0, 180.0, side))
    box = ("__id", "s", "w", "e", "b", "t", "level")
    s = materialise(s.select(*box, F.explode(xs).alias("x"), ys.alias("ys")).select(*box, "x", F.explode("ys").alias("y")), "cells")
    levels = [F.struct(F.lit(n).alias("level"), _cell(F.col("__lon"), -180.0, 360.0, F.lit(1 << n)).alias("x"), _cell(F.col("__lat"), -90.0, 180.0, F.lit(1 << n)).alias("y")) for n in range(FINEST + 1)]
    used = [r.level for r in s.select("level").distinct().collect()]  # 13 at most
    cells = F.array(*(levels[n] for n in sorted(used or [0])))
    p = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(point, F.col(lon).alias("__lon"), F.col(lat).alias("__lat"))
    spots = p.select("__lon", "__lat").distinct().select("__lon", "__lat", F.explode(cells).alias("c")).select("__lon", "__lat", "c.*")
    clamped = lambda c, most: F.greatest(F.lit(-most), F.least(F.lit(most), F.col(c)))
    boxed = clamped("__lon", 180.0).between(F.col("w") - SLIP, F.col("e") + SLIP) & clamped("__lat", 90.0).between(F.col("b") - SLIP, F.col("t") + SLIP)
    met = spots.join(s, ["level", "x", "y"]).filter(boxed).withColumn("km", g.distance_km(F.col("s"), "__lon", "__lat"))
    # written, so that the distances are reckoned once and both joins behind them are plain
    met = materialise(met.filter(F.col("km") <= km).select("__lon", "__lat", "__id", "km"), "met")
    return met.join(members, "__id").join(p, ["__lon", "__lat"]).select(point, key, "km")


def near_place(shapes: DataFrame, geometry: str, lon: float, lat: float, km: float) -> DataFrame:
    """The rows whose shape lies within `km` of a place, with the distance as `km`."""
    found = shapes.withColumn("km", g.distance_km(g.shape(geometry), lon, lat))
    return found.filter(F.col("km") <= km)


def in_box(shapes: DataFrame, geometry: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """The rows of which any part lies in a box."""
    return shapes.filter(g.touches_box(g.shape(geometry), west, south, east, north))


def distant_linked(places: DataFrame, linked: DataFrame, key: str, geometry: str, by: str | None = None) -> DataFrame:
    """(key, distant): of each place how many linked geometries lie beyond its reach and not within it; places with none are left out.

    `places` has (key, geometry) and `linked` (by, geometry): what is linked to all places of one `by`, a column of `places` too,
    is given once; it is the key unless named. Reach is the larger of 150 km and one and a half diagonals, from centre to centre.
    Equal geometries of one `by` are read and compared once, and counted as often as they stand.
    """
    tie = by or key
    one = places.select(F.col(tie).alias("__by"), F.col(geometry).alias("__g"), F.col(key).alias("__key")).filter("__g is not null")
    # written once: shapes, centres and reaches are reckoned for each geometry, not for each pair
    p = one.select("__by", "__g").distinct().withColumn("__id", F.monotonically_increasing_id()).withColumn("p", g.shape("__g")).filter("p is not null")
    p = materialise(p, "places")
    q = linked.select(F.col(tie).alias("__by"), F.col(geometry).alias("__g")).filter("__g is not null").groupBy("__by", "__g").agg(F.count("*").alias("n"))
    q = materialise(q.select("__by", "n", g.shape("__g").alias("q")).filter("q is not null"), "linked")
    q = materialise(q.select("__by", "n", g.centre(F.col("q")).alias("b"), F.col("q.edges").alias("edges"), F.get("q.edges", F.lit(0)).alias("first")), "centres")
    kinds = materialise(p.select("__by", "__id", "p", g.centre(F.col("p")).alias("a"), g.reach_km(F.col("p")).alias("reach")), "reaches")
    far = haversine(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")) > F.col("reach")
    begins = F.col("first.x1").between(F.col("p.west"), F.col("p.east")) & F.col("first.y1").between(F.col("p.south"), F.col("p.north"))
    covered = F.when(begins, F.forall("edges", lambda e: g.inside(F.col("p"), e["x1"], e["y1"]))).otherwise(False)
    counts = kinds.join(q, "__by").filter(far & ~F.coalesce(covered, F.lit(False))).groupBy("__id").agg(F.sum("n").alias("distant"))
    members = one.join(p.select("__by", "__g", "__id"), ["__by", "__g"]).select("__key", "__id")
    return members.join(counts, "__id").groupBy(F.col("__key").alias(key)).agg(F.sum("distant").alias("distant"))
