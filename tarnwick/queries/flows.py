"""Flow, source, sink and stream queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnwick.plans import flow
from tarnwick.queries import query
from tarnwick.session import ROWS_A_TASK, shared_dir, table
from tarnwick.sources import documents, outputs
from tarnwick.streaming import events as stream


@query(
    "with c as (select doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 1600)) as s from documents), k as (select doc_id, cast(sum(greatest(ceil(length(substr(text, cast(greatest(s - 200, 0) + 1 as bigint), cast(least(least(s + 1600, length(text)) + 200, length(text)) - greatest(s - 200, 0) as bigint))) / 4), 1)) as bigint) as tokens, cast(count(*) as bigint) as chunks from c group by 1),"
    " n as (select doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]{3,}')) as name from documents), e as (select doc_id, count(*) as names, count(distinct lower(name)) as different_names from n group by 1)"
    " select doc_id, '{\"chunks\":' || chunks || case when names is null then '' else ',\"different_names\":' || different_names || ',\"names\":' || names end || ',\"tokens\":' || tokens || '}' as result from k left join e using (doc_id)"
)
def flow_run(spark, sf_dir):
    """Two branches from one input, joined again: chunks with their sizes, and names."""
    f = flow.Flow(
        {"in": ("table_input", {"table": "documents"}), "ascii": ("filter", {"where": "text is not null"}), "chunk": ("chunker", {"target": 400, "overlap": 50}), "size": ("measure", {}), "names": ("extract", {"into": "names"}), "both": ("gather", {}), "out": ("output", {})},
        [("in", "chunk"), ("in", "ascii"), ("ascii", "names"), ("chunk", "size"), ("size", "both"), ("names", "both"), ("both", "out")],
    )
    return f.frames(flow.steps(spark, sf_dir))["out"]


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/tarnwick-query-{uuid.uuid4().hex}"


@query("select case when turn % 3 = 0 then null else trim(text) end as text, case when turn % 3 = 0 then 'no text' end as problem from conversations where trim(text) <> ''")
def json_documents(spark, sf_dir):
    path = _folder(spark)
    rows = table(spark, sf_dir, "conversations").filter("trim(text) != ''").selectExpr("concat(conv_id, '-', turn) as content_id", "case when turn % 3 = 1 then text end as body", "case when turn % 3 = 2 then text when turn % 3 = 0 then ' ' end as text")
    rows.write.json(path)
    return documents.json_documents(spark, path, keys=("text", "body")).select("text", "problem")


@query("with p as (select s_suppkey, s_suppkey % 3 as m, s_name from supplier) select s_suppkey, s_name, 'Point' as kind, '[' || (s_suppkey % 180) || ',' || (s_suppkey % 90) || ']' as coordinates from p where m <> 2 union all select s_suppkey, s_name, 'Point', '[' || (s_suppkey % 90) || ',' || (s_suppkey % 80) || ']' from p where m = 1")
def geojson_features(spark, sf_dir):
    point = lambda a, b: f"concat('{{\"type\":\"Point\",\"coordinates\":[', s_suppkey % {a}, ',', s_suppkey % {b}, ']}}')"
    geometry = f"case s_suppkey % 3 when 0 then {point(180, 90)} when 1 then concat('{{\"type\":\"GeometryCollection\",\"geometries\":[', {point(180, 90)}, ',', {point(90, 80)}, ']}}') else 'null' end"
    raw = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"concat('{{\"type\":\"Feature\",\"properties\":{{\"name\":\"', s_name, '\"}},\"geometry\":', {geometry}, '}}') as feature")
    found = documents.features(raw)
    return found.select("s_suppkey", F.col("properties")["name"].alias("s_name"), "kind", "coordinates")


@query("select c_custkey, c_name, try_cast(case when c_custkey % 5 = 0 then 'n/a' else cast(c_nationkey as varchar) end as integer) as c_nationkey, null::double as missing from customer")
def csv_list(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "customer").selectExpr("c_custkey as C_CUSTKEY", "c_name as C_Name", "case when c_custkey % 5 = 0 then 'n/a' else cast(c_nationkey as string) end as c_nationkey").write.option("header", True).csv(path)
    return documents.csv_list(spark, path, {"c_custkey": "long", "c_name": "string", "c_nationkey": "int", "missing": "double"})


@query("select o_orderkey, c_name, cast(0 as bigint) as damaged from orders join customer on o_custkey = c_custkey")
def bundle_round_trip(spark, sf_dir):
    """Two tables exported with a manifest, read again with new ids, and joined by them."""
    path = _folder(spark)
    orders, customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    outputs.export_bundle({"orders": orders, "customer": customer}, path)
    bad = outputs.damaged(spark, path, ["orders", "customer"]).agg(F.count("*").alias("damaged"))
    orders, customer = (spark.read.schema(df.schema).json(f"{path}/{name}") for df, name in ((orders, "orders"), (customer, "customer")))
    customer = customer.withColumnRenamed("c_custkey", "o_custkey")
    ids = documents.fresh_ids(customer, F.col("o_custkey"), "import")
    orders, customer = documents.remapped(orders, ids, "o_custkey"), documents.remapped(customer, ids, "o_custkey")
    return orders.join(customer, "o_custkey").select("o_orderkey", "c_name").join(F.broadcast(bad), how="cross")


@query("select o_orderpriority, cast(count(*) as bigint) as orders, cast(max(case when o_orderpriority = '2-HIGH' then 1 else 0 end) as bigint) as version from orders where o_orderpriority <> '2-HIGH' or o_orderstatus = 'F' group by 1")
def replace_partitions(spark, sf_dir):
    """All orders by priority, then one priority written anew with fewer."""
    path = _folder(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").withColumn("version", F.lit(0).cast("long"))
    outputs.replace_partitions(orders, path, "o_orderpriority")
    outputs.replace_partitions(orders.filter("o_orderpriority = '2-HIGH' and o_orderstatus = 'F'").withColumn("version", F.lit(1).cast("long")), path, "o_orderpriority")
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.max("version").alias("version"))


def _arrivals(spark, sf_dir):
    """The events as a stream of four micro-batches, however large: four writes, each with a part of every hour, so old rows come after new ones.

    A write has as many files as keep each to some `ROWS_A_TASK` rows, and a micro-batch takes the files of one write.
    """
    path = _folder(spark)
    events = table(spark, sf_dir, "events")
    files = events.count() // (4 * ROWS_A_TASK) + 1
    for part in (2, 0, 3, 1):
        events.filter(F.pmod(F.hash("event_id"), F.lit(4)) == part).repartition(files).write.mode("append").parquet(f"{path}/events.parquet")
    return stream.read(spark, path, files_per_trigger=files)


@query("select time_bucket(interval '1 day', ts) as start, event_type, cast(count(*) as bigint) as events, round(sum(value), 4) as value from events group by 1, 2")
def stream_rollup(spark, sf_dir):
    rows = stream.run_to_end(stream.rollup(stream.read(spark, sf_dir), "1 day", ["event_type"]), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


@query("select user_id, event_type, cast(1 as bigint) as kept from events group by 1, 2")
def stream_coalesce(spark, sf_dir):
    rows = stream.run_to_end(stream.coalesced(_arrivals(spark, sf_dir), ["user_id", "event_type"], late="60 days"))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("kept"))


@query("with e as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) < 86400000000 then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts) as s from e) select user_id, min(ts) as start, cast(count(*) as bigint) as events from s group by user_id, s")
def stream_sessions(spark, sf_dir):
    rows = stream.run_to_end(stream.sessions(_arrivals(spark, sf_dir), "1 day", ["user_id"], late="60 days"), "complete")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("with e as (select n_nationkey as endpoint, case n_nationkey % 3 when 0 then 'click' when 1 then 'view' else 'purchase' end as event_type from nation) select event_id, endpoint from events join e using (event_type)")
def stream_fanout(spark, sf_dir):
    endpoints = table(spark, sf_dir, "nation").selectExpr("n_nationkey as endpoint", "case n_nationkey % 3 when 0 then 'click' when 1 then 'view' else 'purchase' end as event_type", "cast(null as string) as outcome", "true as active")
    events = stream.read(spark, sf_dir).withColumn("outcome", F.lit("any"))
    return stream.run_to_end(stream.fan_out(events, endpoints).select("event_id", "endpoint"))


@query("select user_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1")
def stream_upsert(spark, sf_dir):
    """The log merged into one row for each user, micro-batch by micro-batch."""
    path = _folder(spark)
    rows = _arrivals(spark, sf_dir)
    merge = stream.merge_each(f"{path}/table", "user_id", ["event_type", "value"])
    q = rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(p["batchId"] for p in q.recentProgress)
    return spark.read.parquet(f"{path}/table/v{last}").select("user_id", "event_type", "value")
