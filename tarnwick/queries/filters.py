"""Filters of list requests, retention, geometry texts and names of source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import geo
from tarnwick.operators import articles as a
from tarnwick.operators import operations as o
from tarnwick.operators import runs
from tarnwick.queries import query
from tarnwick.session import table
from tarnwick.sources import documents


@query("select l_orderkey, l_linenumber, l_partkey, l_returnflag as nature from lineitem where l_returnflag in ('R', 'A')")
def nature_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("nature"))
    return a.of_natures(rows, [" R", "A", "", "R"])


_LINKED = "select o_orderkey, case when o_orderstatus = 'F' then o_custkey end as canonical_id from orders"


@query(f"select canonical_id is not null as present, count(*) as n from ({_LINKED}) group by 1")
def canonical_presence(spark, sf_dir):
    """Entities with and without a canonical, each side by its filter."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("canonical_id"))
    sides = [a.canonical_presence(rows, present).groupBy(F.lit(present).alias("present")).agg(F.count("*").alias("n")) for present in (True, False)]
    return sides[0].unionByName(sides[1])


@query("select event_type, count(*) filter (ts >= timestamp '2024-02-01' - interval 10 day) as kept, count(*) filter (ts < timestamp '2024-02-01' - interval 10 day) as purged from events group by 1")
def retention_purge(spark, sf_dir):
    return o.purge_counts(table(spark, sf_dir, "events"), "event_type", "ts", F.to_timestamp(F.lit("2024-02-01 00:00:00")), days=10)


@query("select event_id from events where ts >= timestamp '2024-02-01' - interval 10 day")
def retained_events(spark, sf_dir):
    return o.retained(table(spark, sf_dir, "events"), "ts", F.to_timestamp(F.lit("2024-02-01 00:00:00")), days=10).select("event_id")


#: Coordinates in quarters of a degree from a customer's keys, so that they print alike everywhere.
_X, _Y = "(c_custkey % 700 - 350) / 4.0 + 0.25", "(c_nationkey - 12) * 2.5 + 0.25"
_TEXT = (
    "case c_custkey % 4 when 0 then '{{\"type\":\"Point\",\"coordinates\":[' || {x} || ',' || {y} || ']}}'"
    " when 1 then '{{\"type\":\"LineString\",\"coordinates\":[[' || {x} || ',' || {y} || ',300.5],[' || {x1} || ',' || {y1} || ',310.5]]}}'"
    " when 2 then '{{\"type\":\"Polygon\",\"coordinates\":[[[' || {x} || ',' || {y} || '],[' || {x1} || ',' || {y} || '],[' || {x1} || ',' || {y1} || ']]]}}'"
    " else '{{\"type\":\"Circle\",\"coordinates\":[' || {x} || ']}}' end"
).format(x=f"cast(cast({_X} as double) as {{t}})", y=f"cast(cast({_Y} as double) as {{t}})", x1=f"cast(cast({_X} + 1 as double) as {{t}})", y1=f"cast(cast({_Y} + 1 as double) as {{t}})")
_PLACE = f"(select c_custkey, c_custkey % 4 as kind, cast({_X} as double) as x, cast({_Y} as double) as y from customer)"


def _shapes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_TEXT.replace("{t}", "string")).alias("geometry"))


@query(
    "select c_custkey, case kind when 0 then 'POINT (' || x || ' ' || y || ')' when 1 then 'LINESTRING (' || x || ' ' || y || ', ' || (x + 1) || ' ' || (y + 1) || ')'"
    f" when 2 then 'POLYGON ((' || x || ' ' || y || ', ' || (x + 1) || ' ' || y || ', ' || (x + 1) || ' ' || (y + 1) || ', ' || x || ' ' || y || '))' end as wkt from {_PLACE}"
)
def geometry_wkt(spark, sf_dir):
    """Shapes as well-known text: altitudes go, rings are closed, an unknown type is null."""
    return _shapes(spark, sf_dir).select("c_custkey", geo.geojson_wkt("geometry").alias("wkt"))


@query(f"select c_custkey, x as west, y as south, case kind when 0 then x else x + 1 end as east, case kind when 0 then y else y + 1 end as north from {_PLACE} where kind in (1, 2)")
def geometry_box(spark, sf_dir):
    """Bounding boxes of lines with altitudes and of polygons."""
    return _shapes(spark, sf_dir).filter("c_custkey % 4 in (1, 2)").select("c_custkey", geo.geojson_box("geometry").alias("b")).select("c_custkey", "b.*")


_FILE = "concat('in/', substr(cast(o_orderdate as {t}), 1, 10), '/story-', case when o_orderkey % 5 = 0 then '' else lpad(cast(o_custkey as {t}), 10, 'c') || '-' end, lpad(cast(o_orderkey as {t}), 10, 'k'), case when o_orderkey % 3 = 0 then '-output' else '' end, '.json')"


@query(
    "select o_orderkey, substr(cast(o_orderdate as varchar), 1, 10) as day, case when o_orderkey % 5 <> 0 and o_orderkey % 3 <> 0 then lpad(cast(o_custkey as varchar), 10, 'c') end as article_id,"
    " lpad(cast(o_orderkey as varchar), 10, 'k') as update_key from orders"
)
def source_file_parts(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_FILE.replace("{t}", "string")).alias("path"))
    return files.select("o_orderkey", documents.source_file_parts("path").alias("p")).select("o_orderkey", "p.*")


@query(
    "with n as (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as n from part), t as (select distinct p_name from part where p_size = 3),"
    " f as (select p_name, list_filter(range(1, c + 3), lambda i: not ((i = 1 and taken) or i = 4)) as free from (select p_name, count(*) as c, p_name in (select p_name from t) as taken from part group by p_name))"
    " select p_partkey, replace(p_name, ' ', '-') || case when free[n] = 1 then '' else '-' || free[n] end as slug from n join f using (p_name)"
)
def slug_allocation_taken(spark, sf_dir):
    """Slugs beside those taken: the plain ones of some names, and number 4 of every name."""
    part = table(spark, sf_dir, "part")
    base = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    taken = part.filter("p_size = 3").select(base.alias("slug")).unionByName(part.select(F.concat(base, F.lit("-4")).alias("slug"))).distinct()
    return runs.slugs(part, "p_partkey", "p_name", taken)
