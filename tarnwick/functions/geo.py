"""Distances, boxes and grid cells as column expressions over longitudes and latitudes in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean radius of the earth, and metres in a mile.
EARTH_KM = 6371.0
EARTH_MILES = 3958.7613
METRES_PER_MILE = 1609.34


def _c(x: str | Column | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lon1, lat1, lon2, lat2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the unit of `radius`; null where a coordinate is."""
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat, half_lon = (a2 - a1) / 2, F.radians(_c(lon2) - _c(lon1)) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def in_box(lon, lat, west: float, south: float, east: float, north: float) -> Column:
    """Whether a point lies in a box; `west` beyond `east` crosses the antimeridian."""
    across = _c(lon).between(west, east) if west <= east else (_c(lon) >= west) | (_c(lon) <= east)
    return across & _c(lat).between(south, north)


def near(lon, lat, at_lon: float, at_lat: float, km: float) -> Column:
    """Within `km` of a place: first by a box, which filters can push down, then by distance."""
    import math

    dlat = math.degrees(km / EARTH_KM)
    south, north = at_lat - dlat, at_lat + dlat
    if north >= 90 or south <= -90:
        return _c(lat).between(max(south, -90.0), min(north, 90.0)) & (haversine(lon, lat, at_lon, at_lat) <= km)
    reach = math.degrees(math.asin(min(1.0, math.sin(km / EARTH_KM) / math.cos(math.radians(at_lat)))))
    west, east = at_lon - reach, at_lon + reach
    west, east = (west + 360 if west < -180 else west), (east - 360 if east > 180 else east)
    return in_box(lon, lat, west, south, east, north) & (haversine(lon, lat, at_lon, at_lat) <= km)


def decay(distance_m: str | Column, scale: float = 2500.0) -> Column:
    """1 at no distance, falling by e for each `scale` metres."""
    return F.when(_c(distance_m) <= 0, 1.0).otherwise(F.exp(-_c(distance_m) / scale))


def cell(lon, lat, level: int) -> Column:
    """A quadrant key: each level halves both axes; a parent is a prefix."""
    side = 1 << level
    x = F.least(F.lit(side - 1), F.floor((_c(lon) + 180) / 360 * side)).cast("long")
    y = F.least(F.lit(side - 1), F.floor((_c(lat) + 90) / 180 * side)).cast("long")
    digits = [F.pmod(F.shiftright(x, level - 1 - k), F.lit(2)) + 2 * F.pmod(F.shiftright(y, level - 1 - k), F.lit(2)) for k in range(level)]
    return F.concat(*(d.cast("string") for d in digits)) if digits else F.lit("")


def parent(key: str | Column, level: int) -> Column:
    """The cell of `level` that holds a finer one; null for a coarser cell."""
    return F.when(F.length(_c(key)) >= level, F.substring(_c(key), 1, level))


def geojson_box(geometry: str) -> Column:
    """struct(west, south, east, north) of a GeoJSON text: the first two numbers of each position, whatever altitude follows."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    position = F.lit(rf"\[\s*{number}\s*,\s*{number}[^\[\]]*\]")
    part = lambda k: F.transform(F.regexp_extract_all(F.get_json_object(geometry, "$.coordinates"), position, F.lit(k)), lambda x: x.cast("double"))
    lon, lat = part(1), part(2)
    return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def geojson_wkt(geometry: str) -> Column:
    """Well-known text of a GeoJSON Point, MultiPoint, LineString or Polygon; null for anything else.

    Altitudes are left out, and an open ring is closed. A line needs two positions, a ring three.
    """
    kind = F.initcap(F.get_json_object(geometry, "$.type"))
    coordinates = F.get_json_object(geometry, "$.coordinates")
    pair = lambda p: F.when(F.size(p) >= 2, F.concat(p[0].cast("string"), F.lit(" "), p[1].cast("string")))
    # an incomplete position makes a list shorter than what it came from
    whole = lambda found, source: F.size(F.filter(found, lambda x: x.isNotNull())) == F.size(source)
    point = F.from_json(coordinates, "array<double>")
    line = F.from_json(coordinates, "array<array<double>>")
    rings = F.from_json(coordinates, "array<array<array<double>>>")
    pairs = F.transform(line, pair)
    closed = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    ring = lambda r: F.when((F.size(r) >= 3) & whole(F.transform(r, pair), r), F.concat(F.lit("("), F.array_join(closed(F.transform(r, pair)), ", "), F.lit(")")))
    drawn = F.transform(rings, ring)
    return (
        F.when(kind == "Point", F.concat(F.lit("POINT ("), pair(point), F.lit(")")))
        .when((kind == "Multipoint") & (F.size(line) > 0) & whole(pairs, line), F.concat(F.lit("MULTIPOINT ("), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("("), p, F.lit(")"))), ", "), F.lit(")")))
        .when((kind == "Linestring") & (F.size(line) > 1) & whole(pairs, line), F.concat(F.lit("LINESTRING ("), F.array_join(pairs, ", "), F.lit(")")))
        .when((kind == "Polygon") & (F.size(rings) > 0) & whole(drawn, rings), F.concat(F.lit("POLYGON ("), F.array_join(drawn, ", "), F.lit(")")))
    )


def coverage_level(cells, column: str, most: int = 5000) -> int:
    """The finest level at which the quadrant keys of a frame are at most `most` cells: one aggregate counts all levels."""
    deepest = cells.agg(F.max(F.length(column))).first()[0] or 0
    if not deepest:
        return 0
    row = cells.agg(*(F.count_distinct(parent(column, n)).alias(str(n)) for n in range(1, deepest + 1))).first()
    return max((n for n in range(1, deepest + 1) if row[str(n)] <= most), default=0)


def viewport_level(west: float, south: float, east: float, north: float, across: int = 32, finest: int = 15) -> int:
    """The level at which a view shows about `across` cells by the geometric mean of its sides."""
    import math

    side = math.sqrt(max(1e-9, (east - west) % 360 or 360) / 360 * max(1e-9, north - south) / 180)
    return max(0, min(finest, round(math.log2(across / side))))
