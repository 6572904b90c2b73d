"""Geographic queries: places derived from keys, the same way in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import geo
from tarnwick.operators import catalog as c
from tarnwick.queries import query
from tarnwick.session import table

_AT = "cast(({0} * 37 % 360) - 180 as double) as {1}lon, cast(({0} * 17 % 180) - 90 as double) as {1}lat"
_HAV = "2 * {4} * asin(least(1.0, sqrt(pow(sin((radians({3}) - radians({1})) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - {0}) / 2), 2))))"


def places(spark, sf_dir, name: str, key: str, prefix: str = ""):
    return table(spark, sf_dir, name).withColumns({f"{prefix}lon": (F.col(key) * 37 % 360 - 180).cast("double"), f"{prefix}lat": (F.col(key) * 17 % 180 - 90).cast("double")})


@query(f"with s as (select s_suppkey, {_AT.format('s_suppkey', '')} from supplier) select s_suppkey, round({_HAV.format('lon', 'lat', '-87.6298', '41.8781', '6371.0')}, 4) as km from s")
def haversine(spark, sf_dir):
    return places(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", F.round(geo.haversine("lon", "lat", -87.6298, 41.8781), 4).alias("km"))


@query(f"with c as (select c_custkey, {_AT.format('c_custkey', '')} from customer) select c_custkey from c where {_HAV.format('lon', 'lat', '170.0', '-20.0', '6371.0')} <= 2000")
def haversine_radius(spark, sf_dir):
    rows = places(spark, sf_dir, "customer", "c_custkey")
    return rows.filter(geo.near("lon", "lat", 170.0, -20.0, 2000.0)).select("c_custkey")


@query(f"with c as (select c_custkey, {_AT.format('c_custkey', '')} from customer) select c_custkey, lon, lat from c where (lon >= 150 or lon <= -160) and lat between -30 and 30")
def bbox_range(spark, sf_dir):
    return places(spark, sf_dir, "customer", "c_custkey").filter(geo.in_box("lon", "lat", 150, -30, -160, 30)).select("c_custkey", "lon", "lat")


@query("select p_partkey, round(case when p_size * 300.0 - 600 <= 0 then 1.0 else exp(-(p_size * 300.0 - 600) / 2500) end, 6) as weight from part")
def spatial_decay(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(geo.decay(F.col("p_size") * 300.0 - 600), 6).alias("weight"))


_CELL = "cast(floor((lon + 180) / 360 * 8) as bigint) as x, cast(floor((lat + 90) / 180 * 8) as bigint) as y"
_KEY = "((x >> 2) % 2 + 2 * ((y >> 2) % 2)) || '' || ((x >> 1) % 2 + 2 * ((y >> 1) % 2)) || '' || (x % 2 + 2 * (y % 2))"


def _cells(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    at = places(spark, sf_dir, "customer", "c_custkey").select("c_custkey", geo.cell("lon", "lat", 5).alias("fine"))
    return orders.join(at, F.col("o_custkey") == F.col("c_custkey")).withColumn("cell", geo.parent("fine", 3))


@query(f"with c as (select c_custkey, {_AT.format('c_custkey', '')} from customer), x as (select c_custkey, {_CELL} from c) select {_KEY} as cell, cast(count(distinct o_orderkey) as bigint) as articles from orders join x on o_custkey = c_custkey group by 1")
def grid_cell_counts(spark, sf_dir):
    return _cells(spark, sf_dir).filter("cell is not null").groupBy("cell").agg(F.count_distinct("o_orderkey").alias("articles"))


@query(f"with c as (select c_custkey, {_AT.format('c_custkey', '')} from customer), x as (select c_custkey, {_CELL} from c), n as (select {_KEY} as cell, count(distinct o_orderkey) as n from orders join x on o_custkey = c_custkey group by 1), r as (select unnest(['000', '123', '333', '999']) as cell) select cell, cast(coalesce(n, 0) as bigint) as articles from r left join n using (cell)")
def grid_batch_totals(spark, sf_dir):
    asked = spark.createDataFrame([("000",), ("123",), ("333",), ("999",)], "cell string")
    # the requested cells are at most 200, so they filter before the count
    found = _cells(spark, sf_dir).join(F.broadcast(asked), "cell").groupBy("cell").agg(F.count_distinct("o_orderkey").alias("articles"))
    return asked.join(found, "cell", "left").select("cell", F.coalesce("articles", F.lit(0)).cast("long").alias("articles"))


@query(
    f"with e as (select s_suppkey as id, s_name as label, case when s_suppkey % 11 <> 0 then lon end as lon, lat, s_nationkey from (select *, {_AT.format('s_suppkey', '')} from supplier)),"
    f" m as (select distinct l_suppkey as id, {_AT.format('n_nationkey', 'at_')} from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"
    f" select id, label, 'missing_geometry' as issue from e where lon is null or lat is null union all select distinct e.id, label, 'distant' from e join m on e.id = m.id where lon is not null and lat is not null and {_HAV.format('lon', 'lat', 'at_lon', 'at_lat', '6371.0')} > 9000"
)
def geo_issue_union(spark, sf_dir):
    e = places(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.when(F.col("s_suppkey") % 11 != 0, F.col("lon")).alias("lon"), "lat")
    nations = places(spark, sf_dir, "nation", "n_nationkey", "at_").select("n_nationkey", "at_lon", "at_lat")
    linked = table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return c.geography_issues(e, linked.select(F.col("l_suppkey").alias("id"), "at_lon", "at_lat"), 9000.0)


@query(f"with c as (select c_custkey, {_AT.format('c_custkey', '')} from customer), x as (select c_custkey, {_CELL} from c), k as (select c_custkey, {_KEY} as cell from x) select cell, cast(count(*) as bigint) as places from k group by 1")
def grid_coverage(spark, sf_dir):
    """Cells as fine as 64 of them allow."""
    rows = places(spark, sf_dir, "customer", "c_custkey").select(geo.cell("lon", "lat", 6).alias("fine"))
    level = geo.coverage_level(rows, "fine", 64)
    return rows.groupBy(geo.parent("fine", level).alias("cell")).agg(F.count("*").alias("places"))
