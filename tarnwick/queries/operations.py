"""Operations queries: events as an ordered log, orders as runs, line items as priced calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import text
from tarnwick.operators import articles as a
from tarnwick.operators import operations as o
from tarnwick.queries import query
from tarnwick.session import table

_NOW = "timestamp '2024-01-31'"


def _now():
    return F.to_timestamp(F.lit("2024-01-31"))


@query("select l_returnflag, l_linestatus, cast(sum(case when l_linenumber % 7 = 6 then 0 else cast(l_extendedprice as decimal(18,6)) end) as double) as cost, max(case when l_linenumber % 7 = 6 then 1 else 0 end) = 1 as incomplete, 'USD' as currency, cast(count(*) as bigint) as calls from lineitem group by 1, 2")
def cost_rollup(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").withColumn("cost", F.when(F.col("l_linenumber") % 7 != 6, F.col("l_extendedprice"))).withColumn("currency", F.lit("USD"))
    return o.costs(calls, ["l_returnflag", "l_linestatus"]).withColumn("cost", F.col("cost").cast("double"))


@query("select o_orderpriority, cast(count(*) filter (o_orderstatus = 'F') as bigint) as f, cast(count(*) filter (o_orderstatus = 'O') as bigint) as o, cast(count(*) filter (o_orderstatus = 'P') as bigint) as p, cast(count(*) as bigint) as total from orders group by 1")
def status_pivot(spark, sf_dir):
    return o.status_pivot(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query("with d as (select o_orderpriority, greatest((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6, 0.0) as s from orders join lineitem on o_orderkey = l_orderkey) select o_orderpriority, round(avg(s), 3) as avg_s, min(s) as min_s, max(s) as max_s from d group by 1")
def duration_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("s", o.duration("o_orderdate", "l_shipdate"))
    return rows.groupBy("o_orderpriority").agg(F.round(F.avg("s"), 3).alias("avg_s"), F.min("s").alias("min_s"), F.max("s").alias("max_s"))


@query("select o_custkey, round(avg(o_totalprice), 4) as avg_price, cast(count(*) as bigint) as runs from orders group by 1 order by avg(o_totalprice) desc, o_custkey limit 5")
def top_flows(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("runs"))
    return a.page(by, [F.desc("m"), F.col("o_custkey")], 5).select("o_custkey", F.round("m", 4).alias("avg_price"), "runs")


@query("select o_orderstatus, o_orderpriority, cast(count(*) as bigint) as items from orders group by 1, 2")
def run_status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("items"))


@query("select c_mktsegment, round(avg(coalesce(cost, 0)), 4) as avg_cost, cast(count(*) as bigint) as customers from customer left join (select o_custkey, sum(o_totalprice) as cost from orders group by 1) on c_custkey = o_custkey group by 1")
def left_join_cost_avg(spark, sf_dir):
    cost = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("cost"))
    rows = table(spark, sf_dir, "customer").join(cost, "c_custkey", "left")
    return rows.groupBy("c_mktsegment").agg(F.round(F.avg(F.coalesce("cost", F.lit(0.0))), 4).alias("avg_cost"), F.count("*").alias("customers"))


@query("select o_custkey, o_orderkey, o_totalprice from (select *, max(o_orderdate) over (partition by o_custkey) as m from orders) where o_orderdate = m")
def latest_attempt(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return orders.join(last, ["o_custkey", "o_orderdate"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"select event_id, event_type, user_id from events where event_id > 40 and ts >= {_NOW} - interval 90 days and event_type = 'click' order by event_id limit 100")
def event_feed_page(spark, sf_dir):
    return o.feed(table(spark, sf_dir, "events"), _now(), after=40, kind="click").select("event_id", "event_type", "user_id")


@query("select event_id, replace(replace(rtrim(base64(encode('v1:' || event_id || ':' || cast(epoch(ts) as bigint))), '='), '+', '-'), '/', '_') as cursor, event_id as sequence, cast(floor(epoch(ts)) as bigint) < epoch(timestamp '2024-04-10') - 90 * 86400 as expired from (select event_id, date_trunc('second', ts) as ts from events)")
def event_cursor(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", text.cursor("event_id", F.unix_timestamp(F.date_trunc("second", "ts"))).alias("cursor"))
    back = text.read_cursor("cursor")
    return rows.select("event_id", "cursor", back["sequence"].alias("sequence"), o.expired(back["seconds"], F.to_timestamp(F.lit("2024-04-10"))).alias("expired"))


@query("select user_id, event_type, cast(day as varchar) as day, event_id from (select user_id, event_type, cast(ts as date) as day, event_id, row_number() over (partition by user_id, event_type, cast(ts as date) order by event_id) as n from events) where n = 1")
def event_coalesce(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return o.coalesced(rows, ["user_id", "event_type", "day"], "event_id").select("user_id", "event_type", "day", "event_id")


_ENDPOINTS = "endpoints as (select n_nationkey as endpoint, case n_nationkey % 3 when 0 then 'click' when 1 then 'view' else 'purchase' end as event_type, case when n_nationkey % 2 = 0 then 'high' end as outcome, n_nationkey % 5 <> 0 as active from nation)"


def _endpoints(spark, sf_dir):
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey as endpoint", "case n_nationkey % 3 when 0 then 'click' when 1 then 'view' else 'purchase' end as event_type", "case when n_nationkey % 2 = 0 then 'high' end as outcome", "n_nationkey % 5 != 0 as active")


@query(f"with {_ENDPOINTS}, e as (select event_id, event_type, case when value > 50 then 'high' else 'low' end as outcome from events) select event_id, endpoint from e join endpoints p on e.event_type = p.event_type where active and (p.outcome is null or p.outcome = e.outcome)")
def event_fanout(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") > 50, "high").otherwise("low").alias("outcome"))
    return o.fan_out(events, _endpoints(spark, sf_dir)).select("event_id", "endpoint")


_DELIVERIES = f"d as (select event_id, cast(user_id % 25 as integer) as endpoint, case event_id % 4 when 0 then 'pending' when 1 then 'delivering' when 2 then 'delivered' else 'failed' end as state, ts + interval 10 day as next_at, ts + interval 5 day as lease_until from events)"


@query(f"with {_ENDPOINTS}, {_DELIVERIES} select event_id, endpoint, state from d where ((state = 'pending' and next_at <= {_NOW}) or (state = 'delivering' and lease_until < {_NOW})) and endpoint in (select endpoint from endpoints where active)")
def due_deliveries(spark, sf_dir):
    d = table(spark, sf_dir, "events").selectExpr("event_id", "cast(user_id % 25 as int) as endpoint", "case event_id % 4 when 0 then 'pending' when 1 then 'delivering' when 2 then 'delivered' else 'failed' end as state", "ts + interval 10 days as next_at", "ts + interval 5 days as lease_until")
    return o.due(d, _endpoints(spark, sf_dir), _now()).select("event_id", "endpoint", "state")


@query(
    "with e as (select event_id, event_id % 9 + 1 as attempt, cast(case when event_id % 10 = 0 then 500 end as double) as after_s, 200 + 100 * (event_id % 4) + case when event_id % 8 = 6 then 29 else 0 end as code from events)"
    " select event_id, round(greatest(least(30 * pow(2.0, attempt - 1), 3600.0) * (1 + (('0x' || substr(md5(cast(event_id as varchar)), 1, 8))::bigint % 4001) / 10000.0 - 0.2), coalesce(after_s, 0)), 6) as wait_s,"
    " case when code between 200 and 299 then 'delivered' when (code between 400 and 499 and code not in (408, 429)) or attempt * 12000 > 86400 then 'failed' else 'retry' end as outcome from e"
)
def retry_backoff(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 9 + 1 as attempt", "case when event_id % 10 = 0 then 500 end as after_s", "200 + 100 * (event_id % 4) + case when event_id % 8 = 6 then 29 else 0 end as code")
    return e.select("event_id", F.round(o.backoff(F.col("attempt"), F.col("event_id").cast("string"), F.col("after_s")), 6).alias("wait_s"), o.outcome(F.col("code"), F.col("attempt") * 12000).alias("outcome"))


@query("with r as (select event_id, user_id, sha256(event_type) as h from events), f as (select *, first_value(h) over (partition by user_id order by event_id) as fh, row_number() over (partition by user_id order by event_id) as n from r) select event_id, case when n = 1 then 'run' when h = fh then 'repeat' else 'conflict' end as result from f")
def idempotency(spark, sf_dir):
    return o.idempotent(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("event_id", "result")


@query("select event_id, user_id, event_type, ts from events where event_type = 'view' and ts >= timestamp '2024-01-20' order by ts desc, event_id desc limit 60")
def activity_feed(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'view' and ts >= timestamp '2024-01-20'").select("event_id", "user_id", "event_type", "ts")
    return a.page(rows, [F.desc("ts"), F.desc("event_id")], 60)


@query("select n_nationkey, cast(count(*) filter (c_acctbal < 0) as bigint) as open, cast(count(*) filter (c_acctbal >= 9000) as bigint) as deferred from nation left join customer on n_nationkey = c_nationkey group by 1")
def candidate_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return o.by_project(rows, table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", {"open": F.col("c_acctbal") < 0, "deferred": F.col("c_acctbal") >= 9000})
