"""Lines and polygons of GeoJSON as column expressions: what holds a point, how far it is, what a box touches.

A shape is a struct of its box, whether it has an area, and its edges in degrees; a point is an edge of no length.
Holes count by parity. Distances to edges are measured in the plane that touches the earth at the point: exact for near
shapes, within one part in a hundred to some 500 km. A shape must not cross the antimeridian; altitudes are left out.
Null, unknown and broken geometry is a null shape, and gives nulls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions.geo import EARTH_KM, haversine

DEGREE_KM = EARTH_KM * math.pi / 180
#: The least distance, and the part of the diagonal, beyond which a linked place is distant.
LEAST_KM, SLACK = 150.0, 1.5


def _c(x: str | Column | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def shape(geometry: str) -> Column:
    """struct(area, west, south, east, north, edges) of a GeoJSON text of any plain or multiple type."""
    kind, text = F.lower(F.get_json_object(geometry, "$.type")), F.get_json_object(geometry, "$.coordinates")
    nested = lambda depth: F.from_json(text, "array<" * depth + "double" + ">" * depth)
    area = kind.isin("polygon", "multipolygon")
    parts = (
        F.when(kind == "point", F.array(F.array(nested(1))))
        .when(kind == "multipoint", F.transform(nested(2), lambda p: F.array(p)))
        .when(kind == "linestring", F.array(nested(2)))
        .when(kind.isin("polygon", "multilinestring"), nested(3))
        .when(kind == "multipolygon", F.flatten(nested(4)))
    )
    whole = F.forall(parts, lambda r: (F.size(r) > 0) & F.forall(r, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull()))
    ring = lambda r: F.when(area, F.concat(r, F.slice(r, 1, 1))).otherwise(r)
    edge = lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    pairs = lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0))), lambda i: edge(F.get(r, i), F.get(r, F.least(i + 1, F.size(r) - 1))))
    edges = F.flatten(F.transform(parts, lambda r: pairs(ring(r))))
    side = lambda k, pick: pick(F.transform(F.flatten(parts), lambda p: p[k]))
    box = [side(0, F.array_min).alias("west"), side(1, F.array_min).alias("south"), side(0, F.array_max).alias("east"), side(1, F.array_max).alias("north")]
    return F.when(whole & (F.size(parts) > 0), F.struct(area.alias("area"), *box, edges.alias("edges")))


def inside(s: Column, lon, lat) -> Column:
    """Whether a point lies in the area of a shape: a ray from it crosses an odd number of edges."""
    x, y = _c(lon), _c(lat)
    crossing = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return s["area"] & (F.size(F.filter(s["edges"], crossing)) % 2 == 1)


def distance_km(s: Column, lon, lat) -> Column:
    """From a point to a shape: none within its area, else to the nearest edge."""
    x, y = _c(lon), _c(lat)
    wide = F.lit(DEGREE_KM) * F.cos(F.radians(y))

    def to(e: Column) -> Column:
        turn = lambda d: F.pmod(d + 180, F.lit(360.0)) - 180
        ax, ay = turn(e["x1"] - x) * wide, (e["y1"] - y) * DEGREE_KM
        dx, dy = (e["x2"] - e["x1"]) * wide, (e["y2"] - e["y1"]) * DEGREE_KM
        along = F.coalesce(-(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.hypot(ax + along * dx, ay + along * dy)

    return F.when(inside(s, x, y), 0.0).otherwise(F.array_min(F.transform(s["edges"], to)))


def touches_box(s: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether any part of a shape lies in a box: an edge meets it, or the area holds it; `west` beyond `east` crosses the antimeridian."""
    if west > east:
        return touches_box(s, west, south, 180.0, north) | touches_box(s, -180.0, south, east, north)

    def span(a: Column, b: Column, low: float, high: float) -> tuple[Column, Column]:
        d = F.nullif(b - a, F.lit(0.0))
        first, last = (F.lit(low) - a) / d, (F.lit(high) - a) / d
        here = a.between(low, high)
        return F.coalesce(F.least(first, last), F.when(here, 0.0).otherwise(2.0)), F.coalesce(F.greatest(first, last), F.when(here, 1.0).otherwise(-1.0))

    def meets(e: Column) -> Column:
        (a, b), (c, d) = span(e["x1"], e["x2"], west, east), span(e["y1"], e["y2"], south, north)
        return F.greatest(F.lit(0.0), a, c) <= F.least(F.lit(1.0), b, d)

    near = (s["west"] <= east) & (s["east"] >= west) & (s["south"] <= north) & (s["north"] >= south)
    return near & (F.exists(s["edges"], meets) | inside(s, west, south))


def centre(s: Column) -> Column:
    """struct(lon, lat): the middle of the box."""
    return F.struct(((s["west"] + s["east"]) / 2).alias("lon"), ((s["south"] + s["north"]) / 2).alias("lat"))


def diagonal_km(s: Column) -> Column:
    """The diagonal of the box: its width along the middle parallel, and its height."""
    middle = (s["south"] + s["north"]) / 2
    return F.hypot(haversine(s["west"], middle, s["east"], middle), haversine(s["west"], s["south"], s["west"], s["north"]))


def reach_km(s: Column) -> Column:
    """How far from a shape's centre a linked place may lie."""
    return F.greatest(F.lit(LEAST_KM), F.lit(SLACK) * diagonal_km(s))
