"""Mention queries: line items mention parts, suppliers and (through their order) customers in orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import articles as a
from tarnwick.operators import connections as k
from tarnwick.operators import mentions as m
from tarnwick.queries import query
from tarnwick.session import spread, table

_ARMS = """arms as (
  select l_orderkey as article, l_partkey as entity, l_returnflag as nature, l_linestatus = 'F' as active, 'part' as kind from lineitem
  union all select l_orderkey, l_suppkey, l_returnflag, l_linestatus = 'F', 'supplier' from lineitem
  union all select o_orderkey, o_custkey, o_orderstatus, o_orderstatus <> 'P', 'customer' from orders
)"""


def mentions(spark, sf_dir):
    item, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    arm = lambda key: item.select(F.col("l_orderkey").alias("article"), F.col(key).alias("entity"), F.col("l_returnflag").alias("nature"), (F.col("l_linestatus") == "F").alias("active"))
    customers = orders.select(F.col("o_orderkey").alias("article"), F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("nature"), (F.col("o_orderstatus") != "P").alias("active"))
    return m.arms(part=arm("l_partkey"), supplier=arm("l_suppkey"), customer=customers)


def parts(spark, sf_dir):
    return mentions(spark, sf_dir).filter("kind = 'part'")


@query("select p_brand, o_orderpriority, cast(count(*) as bigint) as mentions from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_linestatus = 'F' group by all")
def mention_arm_join(spark, sf_dir):
    rows = parts(spark, sf_dir).filter("active").join(table(spark, sf_dir, "orders"), F.col("article") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("entity") == F.col("p_partkey"))
    return rows.groupBy("p_brand", "o_orderpriority").agg(F.count("*").alias("mentions"))


@query(f"with {_ARMS} select distinct kind, entity, article, nature from arms where active order by article desc, kind, entity, nature limit 200")
def union_arms_page(spark, sf_dir):
    rows = mentions(spark, sf_dir).filter("active").select("kind", "entity", "article", "nature").distinct()
    return a.page(rows, [F.desc("article"), F.col("kind"), F.col("entity"), F.col("nature")], 200)


@query(f"with {_ARMS} select kind, entity, cast(count(*) as bigint) as mentions from arms where active group by all")
def mention_counts(spark, sf_dir):
    return mentions(spark, sf_dir).filter("active").groupBy("kind", "entity").agg(F.count("*").alias("mentions"))


@query(f"with {_ARMS} select entity, cast(count(*) as bigint) as mentions, cast(count(distinct article) as bigint) as stories from arms where active and kind = 'supplier' group by all")
def story_counts(spark, sf_dir):
    return m.counts(mentions(spark, sf_dir).filter("kind = 'supplier'"))


@query(f"with {_ARMS} select p_partkey, p_name from part where p_partkey in (select entity from arms where active and kind = 'part' group by entity having count(*) >= 15)")
def having_min_mentions(spark, sf_dir):
    busy = m.at_least(parts(spark, sf_dir), 15).withColumnRenamed("entity", "p_partkey")
    return a.having(table(spark, sf_dir, "part").select("p_partkey", "p_name"), busy, "p_partkey")


@query(
    f"with {_ARMS} select o_orderkey as article, "
    + ", ".join(f"cast(count(*) filter (active and kind = '{k}') as bigint) as {k}_mentions, cast(count(distinct entity) filter (active and kind = '{k}') as bigint) as {k}_entities" for k in ("part", "supplier", "customer"))
    + " from orders left join arms on o_orderkey = article group by 1"
)
def hub_counts(spark, sf_dir):
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article"))
    return m.hub(articles, mentions(spark, sf_dir), ["part", "supplier", "customer"])


@query("select o_orderdate as day, cast(count(*) as bigint) as mentions from lineitem join (select o_orderkey, nullif(o_orderdate, (select min(o_orderdate) from orders)) as o_orderdate from orders) on l_orderkey = o_orderkey where l_linestatus = 'F' and o_orderdate is not null group by 1")
def mention_timeline(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_orderdate").alias("first"))
    dated = orders.join(F.broadcast(first), how="cross").select(F.col("o_orderkey").alias("article"), F.nullif("o_orderdate", F.col("first")).alias("day"))
    return m.timeline(parts(spark, sf_dir).join(dated, "article"), "day")


_OCC = "occ as (select conv_id as mention, turn as id, nullif(turn, 1) as place, role as label, text, turn % 5 = 3 as suppressed from conversations)"


def occurrences(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("mention"), F.col("turn").alias("id"), F.nullif("turn", F.lit(1)).alias("place"), F.col("role").alias("label"), "text", (F.col("turn") % 5 == 3).alias("suppressed"))


@query(f"with {_OCC} select mention, id, label from (select *, row_number() over (partition by mention order by place asc nulls last, id, label, text) as n from occ where not suppressed) where n = 1")
def first_occurrence(spark, sf_dir):
    return m.first_occurrence(occurrences(spark, sf_dir), "mention", [F.asc_nulls_last("place"), F.col("id"), F.col("label"), F.col("text")]).select("mention", "id", "label")


@query(f"with {_OCC} select mention, id from (select *, row_number() over (partition by mention order by place asc nulls last, id, label, text) as n from occ where not suppressed) where n = 1 and lower(trim(label)) = 'system'")
def first_occurrence_quoted(spark, sf_dir):
    rows = occurrences(spark, sf_dir).withColumn("label", F.when(F.col("label") == "system", "quote").otherwise(F.col("label")))
    first = m.first_occurrence(rows, "mention", [F.asc_nulls_last("place"), F.col("id"), F.col("label"), F.col("text")])
    return first.withColumn("quote", F.lit(" ")).filter(m.quoted("quote", "label")).select("mention", "id")


@query(f"with {_ARMS}, g as (select article, string_agg(distinct cast(entity as varchar), ',' order by cast(entity as varchar)) as entities from arms where active and kind = 'part' group by 1) select article, entities, o_orderdate from g join orders on article = o_orderkey order by o_orderdate desc, article desc limit 40")
def group_and_page(spark, sf_dir):
    grouped = parts(spark, sf_dir).filter("active").groupBy("article").agg(F.array_join(F.array_sort(F.collect_set(F.col("entity").cast("string"))), ",").alias("entities"))
    dated = grouped.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article"), "o_orderdate"), "article")
    return a.page(dated, [F.desc("o_orderdate"), F.desc("article")], 40)


@query("select c_custkey, greatest(timestamp '1995-06-01', max(o_orderdate)) as active_at from customer left join orders on c_custkey = o_custkey group by 1")
def recent_activity_sort(spark, sf_dir):
    entities = table(spark, sf_dir, "customer").select("c_custkey", F.to_timestamp(F.lit("1995-06-01")).alias("updated"))
    children = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("updated"))
    return m.recent_activity(entities, children, "c_custkey").select("c_custkey", "active_at")


@query(
    "with p as (select distinct o_custkey as c, l_suppkey as s from orders join lineitem on o_orderkey = l_orderkey), e as (select 'customer' as from_type, c as from_id, 'supplier' as to_type, s as to_id from p where (c + s) % 2 = 0 union all select 'supplier', s, 'customer', c from p where (c + s) % 2 = 1)"
    " select from_type, from_id, to_type, to_id, case when from_type = 'supplier' and from_id = 1 then to_type else from_type end as other_type, case when from_type = 'supplier' and from_id = 1 then to_id else from_id end as other_id from e where (from_type = 'supplier' and from_id = 1) or (to_type = 'supplier' and to_id = 1)"
)
def edges_bidirectional(spark, sf_dir):
    """Edges between customers and suppliers that trade, half of them in each direction, around one supplier."""
    return m.both_ways(_trade(spark, sf_dir), "supplier", 1)


def _trade(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    n = item.count()
    pairs = table(spark, sf_dir, "orders").join(spread(item, "l_orderkey", rows=n), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s"))
    pairs = spread(pairs, "c", "s", rows=n).distinct()
    ahead = pairs.filter("(c + s) % 2 = 0").selectExpr("'customer' as from_type", "c as from_id", "'supplier' as to_type", "s as to_id")
    return ahead.unionByName(pairs.filter("(c + s) % 2 = 1").selectExpr("'supplier' as from_type", "s as from_id", "'customer' as to_type", "c as to_id"))


@query(
    "with p as (select distinct o_custkey as c, l_suppkey as s from orders join lineitem on o_orderkey = l_orderkey), j as (select s_suppkey, c_custkey, lower(c_name) as label, row_number() over (partition by s_suppkey order by lower(c_name), c_custkey) as place from p join customer on c_custkey = c join supplier on s_suppkey = s)"
    " select s_suppkey, c_custkey, cast(place as integer) as place from j where place <= 10"
)
def connections_in_order(spark, sf_dir):
    """The first ten connections of each supplier by the label of the other end."""
    e = _trade(spark, sf_dir)
    out = e.filter("from_type = 'supplier'").selectExpr("from_id as node", "to_id as other_id", "to_type as other_type")
    both = out.unionByName(e.filter("to_type = 'supplier'").selectExpr("to_id as node", "from_id as other_id", "from_type as other_type"))
    labels = table(spark, sf_dir, "customer").selectExpr("'customer' as other_type", "c_custkey as other_id", "c_name as label")
    n = table(spark, sf_dir, "lineitem").count()
    named = spread(both, "other_type", "other_id", rows=n).join(labels, ["other_type", "other_id"])
    rows = k.in_order(spread(named, "node", rows=n), "node", 10)
    return rows.select(F.col("node").alias("s_suppkey"), F.col("other_id").alias("c_custkey"), "place")


@query(
    "select r_name, n_name, p_brand, cast(count(*) as bigint) as mentions, round(sum(l_extendedprice), 2) as value from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"
    " join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where o_orderstatus <> 'P' and p_size < 25 group by all"
)
def five_way_join(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders").filter("o_orderstatus != 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").filter("p_size < 25"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name", "p_brand").agg(F.count("*").alias("mentions"), F.round(F.sum("l_extendedprice"), 2).alias("value"))


@query(f"with {_ARMS}, seen as (select distinct article, kind, entity from arms where active) select a.entity as a, b.entity as b, cast(count(*) as bigint) as stories from seen a join seen b using (article) where a.kind = 'customer' and b.kind = 'supplier' group by 1, 2 having count(*) >= 3")
def comention_pairs(spark, sf_dir):
    return m.co_mentions(mentions(spark, sf_dir), "customer", "supplier", 3)


@query(f"with {_ARMS} select cast(count(*) as bigint) as embedded from (select distinct kind, entity from arms where active and nature <> 'N')")
def distinct_union(spark, sf_dir):
    """Ids of different kinds are different, though they may be equal."""
    rows = mentions(spark, sf_dir).filter("active and nature != 'N'").select("kind", "entity").distinct()
    return rows.agg(F.count("*").alias("embedded"))


@query(f"with {_ARMS} select kind, nature, cast(count(*) as bigint) as mentions, cast(count(distinct entity) as bigint) as entities from arms where active group by 1, 2")
def evidence_counts(spark, sf_dir):
    return mentions(spark, sf_dir).filter("active").groupBy("kind", "nature").agg(F.count("*").alias("mentions"), F.count_distinct("entity").alias("entities"))
