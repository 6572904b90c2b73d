"""Ingest queries: a day's batch against what is stored, both cut from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import text
from tarnwick.operators import ingest as i
from tarnwick.queries import query
from tarnwick.session import table


@query(
    "with s as (select doc_id as id, nullif(source, 'src3') as source, doc_id % 400 as ext, 'u' || (doc_id % 500) as url, md5(text) as fp from documents where doc_id % 2 = 0),"
    " b as (select doc_id as row_id, nullif(source, 'src3') as source, case when doc_id % 3 = 0 then doc_id % 400 end as ext, case when doc_id % 5 > 0 then 'u' || (doc_id % 500) end as url, md5(text) as fp from documents where doc_id % 2 = 1),"
    " m as (select row_id, (select min(id) from s where s.source = b.source and s.ext = b.ext) as m0, (select min(id) from s where s.url = b.url) as m1, (select min(id) from s where s.fp = b.fp) as m2 from b)"
    " select row_id, coalesce(m0, m1, m2) as matched_id, case when m0 is not null then 0 when m1 is not null then 1 when m2 is not null then 2 end as rule from m"
)
def identity_precedence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ext, url, fp, source = F.col("doc_id") % 400, F.concat(F.lit("u"), (F.col("doc_id") % 500).cast("string")), F.md5(F.col("text")), F.nullif("source", F.lit("src3"))
    stored = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), source.alias("source"), ext.alias("ext"), url.alias("url"), fp.alias("fp"))
    batch = docs.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("row_id"), source.alias("source"), F.when(F.col("doc_id") % 3 == 0, ext).alias("ext"), F.when(F.col("doc_id") % 5 > 0, url).alias("url"), fp.alias("fp"))
    return i.identify(batch, stored, "row_id", "id", [["source", "ext"], ["url"], ["fp"]]).select("row_id", "matched_id", "rule")


@query("select c_custkey, sha256('{\"balance\":\"' || cast(cast(c_acctbal as decimal(12,2)) as varchar) || '\",\"name\":\"' || c_name || '\"' || case when c_nationkey % 4 > 0 then ',\"nation\":\"' || c_nationkey || '\"' else '' end || '}') as fp from customer")
def fingerprint(spark, sf_dir):
    fields = {"name": F.col("c_name"), "balance": F.col("c_acctbal").cast("decimal(12,2)"), "nation": F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey")), "note": F.lit("  ")}
    return table(spark, sf_dir, "customer").select("c_custkey", text.fingerprint(**fields).alias("fp"))


@query("select doc_id, sha256(source || chr(10) || text) as fp from documents")
def text_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat("source", F.lit("\n"), "text"), 256).alias("fp"))


_UPSERT = (
    "with o as (select o_orderkey as id, o_orderstatus as status, o_totalprice as price, o_orderpriority as url from orders where o_orderkey % 4 <> 1),"
    " n as (select o_orderkey as id, case when o_orderkey % 3 = 0 then null else o_orderstatus end as status, o_totalprice + case when o_orderkey % 5 = 0 then 1 else 0 end as price, case when o_orderkey % 2 = 0 then o_orderpriority end as url from orders where o_orderkey % 4 <> 2)"
)


def _sides(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = orders.filter("o_orderkey % 4 != 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("url"))
    new = orders.filter("o_orderkey % 4 != 2").selectExpr("o_orderkey as id", "case when o_orderkey % 3 = 0 then null else o_orderstatus end as status", "o_totalprice + case when o_orderkey % 5 = 0 then 1 else 0 end as price", "case when o_orderkey % 2 = 0 then o_orderpriority end as url")
    return old, new


@query(
    _UPSERT + ", j as (select coalesce(o.id, n.id) as id, case when n.id is not null then n.status else o.status end as status, case when n.id is not null then n.price else o.price end as price, coalesce(n.url, o.url) as url, o.id as oid, n.id as nid, o.status as os, o.price as op, o.url as ou from o full join n on o.id = n.id)"
    " select id, status, price, url, case when oid is null then 'inserted' when nid is null then 'kept' when status is not distinct from os and price is not distinct from op and url is not distinct from ou then 'unchanged' else 'changed' end as action from j"
)
def upsert_merge(spark, sf_dir):
    return i.upsert(*_sides(spark, sf_dir), "id", ["status", "price"], ["url"])


_FLAGS = "o_orderkey as id, o_orderkey % 7 = 0 as added, o_orderkey % 11 = 0 as edited, o_orderkey % 13 = 0 as deleted"


def _flagged(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.filter("o_orderkey % 4 != 1").selectExpr(*_FLAGS.split(", ")), orders.filter("o_orderkey % 4 != 2").selectExpr("o_orderkey as id")


_STORED = f"with o as (select {_FLAGS} from orders where o_orderkey % 4 <> 1), n as (select o_orderkey as id from orders where o_orderkey % 4 <> 2)"


@query(
    _STORED + ", j as (select coalesce(o.id, n.id) as id, o.id as oid, n.id as nid, coalesce(added, false) or coalesce(edited, false) as touched from o full join n on o.id = n.id)"
    " select 'add_only' as policy, id, case when oid is null then 'insert' else 'keep' end as action from j"
    " union all select 'smart_merge', id, case when oid is null then 'insert' when touched then 'keep' when nid is not null then 'update' else 'retire' end from j"
    " union all select 'replace', id, case when oid is null then 'insert' when touched then 'keep' when nid is not null then 'replace' else 'delete' end from j"
)
def reconcile_actions(spark, sf_dir):
    old, new = _flagged(spark, sf_dir)
    one = lambda p: i.reconcile(old, new, "id", p).select(F.lit(p).alias("policy"), "id", "action")
    return one("add_only").unionByName(one("smart_merge")).unionByName(one("replace"))


@query(_STORED + " select id, deleted or (id not in (select id from n) and not added and not edited) as deleted from o")
def retire_stale(spark, sf_dir):
    return i.retire(*_flagged(spark, sf_dir), "id").select("id", "deleted")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def orphans_anti(spark, sf_dir):
    mentions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("active"))
    return i.orphans(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), mentions, "c_custkey")


@query("select p_partkey, case when p_partkey % 5 = 1 and p_partkey % 2 = 0 then upper(p_name) else p_name end as p_name, case when p_partkey % 5 = 1 then p_size + 100 else p_size end as p_size from part where p_partkey % 5 <> 0 union all select -p_partkey, p_name, p_size from part where p_partkey % 50 = 7")
def overlay_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    edits = part.selectExpr(
        "p_partkey", "case when p_partkey % 5 = 0 then 'remove' when p_partkey % 5 = 1 then 'edit' end as op", "case when p_partkey % 2 = 0 then upper(p_name) end as p_name", "p_size + 100 as p_size"
    ).filter("op is not null")
    added = part.filter("p_partkey % 50 = 7").selectExpr("-p_partkey as p_partkey", "'add' as op", "p_name", "p_size")
    return i.overlay(part, edits.unionByName(added), "p_partkey", ["p_name", "p_size"])


@query(
    "with s as (select doc_id as id, md5(text) as hash, doc_id % 6 <> 0 as active from documents where doc_id % 5 <> 0), b as (select doc_id as id, md5(case when doc_id % 4 = 0 then text || '.' else text end) as hash from documents where doc_id % 7 <> 0)"
    " select coalesce(s.id, b.id) as id, case when s.id is null then 'create' when b.id is null then case when active then 'deactivate' else 'unchanged' end when not active then 'reactivate' when s.hash = b.hash then 'unchanged' else 'update' end as action from s full join b on s.id = b.id"
)
def semantic_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stored = docs.filter("doc_id % 5 != 0").selectExpr("doc_id as id", "md5(text) as hash", "doc_id % 6 != 0 as active")
    built = docs.filter("doc_id % 7 != 0").selectExpr("doc_id as id", "md5(case when doc_id % 4 = 0 then text || '.' else text end) as hash")
    return i.hash_diff(stored, built, "id")


@query(
    "with e as (select distinct 'customer' as from_type, o_custkey as from_id, 'supplier' as to_type, l_suppkey as to_id from orders join lineitem on o_orderkey = l_orderkey union select 'customer', c_custkey, 'customer', c_custkey - c_custkey % 3 from customer)"
    " select distinct from_type, case when from_type = 'customer' then from_id - from_id % 3 else from_id end as from_id, to_type, case when to_type = 'customer' then to_id - to_id % 3 else to_id end as to_id from e"
    " where not (from_type = to_type and case when from_type = 'customer' then from_id - from_id % 3 else from_id end = case when to_type = 'customer' then to_id - to_id % 3 else to_id end)"
)
def edge_rewire(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    bought = orders.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("'customer' as from_type", "o_custkey as from_id", "'supplier' as to_type", "l_suppkey as to_id").distinct()
    own = customer.selectExpr("'customer' as from_type", "c_custkey as from_id", "'customer' as to_type", "c_custkey - c_custkey % 3 as to_id")
    merged = customer.filter("c_custkey % 3 != 0").selectExpr("'customer' as type", "c_custkey as id", "c_custkey - c_custkey % 3 as into")
    return i.rewire(bought.unionByName(own), merged)


@query("with c as (select l_suppkey % 10 as grp, l_orderkey as article from lineitem where l_quantity > 30), k as (select l_suppkey % 10 as grp, l_orderkey as article from lineitem where l_quantity > 40) select distinct grp, article from c except select grp, article from k")
def snapshot_append(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("grp"), F.col("l_orderkey").alias("article"), "l_quantity")
    return i.append_new(item.filter("l_quantity > 30"), item.filter("l_quantity > 40"), ["grp", "article"])


@query(
    "with a as (select source, doc_id as item, md5(text) as fingerprint from documents), e as (select source, doc_id as item, md5(case when doc_id % 6 = 0 then 'x' else text end) as fingerprint, case doc_id % 3 when 0 then 'succeeded' when 1 then 'failed' else 'running' end as status, case when doc_id % 2 = 0 then timestamp '2024-01-02' else timestamp '2024-01-01' end as lease_until from documents where doc_id % 4 <> 3)"
    " select a.source, a.item, case when status is null then 'new' when status = 'running' and lease_until > timestamp '2024-01-01 12:00:00' then 'busy' when e.fingerprint <> a.fingerprint then 'changed' when status = 'succeeded' then 'done' else 'retry' end as action from a left join e on a.source = e.source and a.item = e.item"
)
def ledger_new_or_retry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    arrivals = docs.selectExpr("source", "doc_id as item", "md5(text) as fingerprint")
    entries = docs.filter("doc_id % 4 != 3").selectExpr(
        "source", "doc_id as item", "md5(case when doc_id % 6 = 0 then 'x' else text end) as fingerprint", "case doc_id % 3 when 0 then 'succeeded' when 1 then 'failed' else 'running' end as status",
        "case when doc_id % 2 = 0 then timestamp '2024-01-02' else timestamp '2024-01-01' end as lease_until",
    )
    return i.ledger(arrivals, entries, F.to_timestamp(F.lit("2024-01-01 12:00:00"))).select("source", "item", "action")


@query("select doc_id, cast(greatest(ceil(length(text) / 4), 1) as bigint) as tokens from documents")
def approx_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.approx_tokens("text").alias("tokens"))


@query(
    "with c as (select doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 400)) as own_start from documents), r as (select *, least(own_start + 400, length(text)) as own_end from c)"
    " select doc_id, cast(own_start as integer) as own_start, cast(own_end as integer) as own_end, md5(substr(text, cast(greatest(own_start - 80, 0) + 1 as bigint), cast(least(own_end + 80, length(text)) - greatest(own_start - 80, 0) as bigint))) as shown from r"
)
def chunk_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return i.chunks(docs, "text", target=100, overlap=20).select("doc_id", "own_start", "own_end", F.md5("chunk_text").alias("shown"))


@query(
    "with d as (select doc_id, lower(text) as t, unnest(range(0, length(text) - 3)) as s from documents) select doc_id, cast(s as integer) as start, cast(s + 4 as integer) as \"end\" from d"
    " where substr(t, s + 1, 4) = 'that' and not regexp_matches(case when s = 0 then ' ' else substr(t, s, 1) end, '[a-z0-9]') and not regexp_matches(coalesce(nullif(substr(t, s + 5, 1), ''), ' '), '[a-z0-9]')"
)
def mention_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("needle", F.lit("That"))
    return i.spans(docs, "text", "needle").select("doc_id", "start", "end")


@query("select doc_id, substr(text, greatest(instr(lower(text), 'with') - 30, 1), instr(lower(text), 'with') + 34 - greatest(instr(lower(text), 'with') - 30, 1)) as snippet from documents where instr(lower(text), 'with') > 0")
def context_snippet(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("needle", F.lit("WITH"))
    return docs.select("doc_id", text.snippet("text", "needle", 30).alias("snippet")).filter("snippet is not null")


@query(
    "with v as (select p_partkey, case p_partkey % 5 when 0 then ' 1,' || lpad(cast(p_size as varchar), 3, '0') || '.5 ' when 1 then 'Yes' when 2 then '2024-02-' || (10 + p_size % 30) when 3 then p_name else ' ' end as v from part)"
    " select p_partkey, try_cast(replace(trim(v), ',', '') as double) as n, case when lower(trim(v)) in ('true', 'yes', '1', 'y') then true when lower(trim(v)) in ('false', 'no', '0', 'n') then false end as b, cast(try_cast(trim(v) as date) as varchar) as d, nullif(trim(v), '') as t from v"
)
def typed_coercion(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "case p_partkey % 5 when 0 then ' 1,' || lpad(cast(p_size as string), 3, '0') || '.5 ' when 1 then 'Yes' when 2 then '2024-02-' || (10 + p_size % 30) when 3 then p_name else ' ' end as v")
    return rows.select("p_partkey", text.coerce("v", "number").alias("n"), text.coerce("v", "boolean").alias("b"), text.coerce("v", "date").cast("string").alias("d"), text.coerce("v", "text").alias("t"))


_EVIDENCE = "e as (select l_orderkey % 300 as article, l_suppkey as entity, l_returnflag as nature, l_shipmode as text, cast(l_quantity as integer) as s, cast(l_quantity as integer) + l_linenumber as e from (select *, l_linestatus as l_shipmode from lineitem))"


def _evidence(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 300 as article", "l_suppkey as entity", "l_returnflag as nature", "l_linestatus as text", "cast(l_quantity as int) as start", "cast(l_quantity as int) + l_linenumber as end")


@query(f"with {_EVIDENCE}, g as (select article, entity, s, e, min(nature) as nature from e group by all), r as (select *, row_number() over (partition by article, entity order by s, e) as n, count(*) over (partition by article, entity) as c from g) select article, entity, nature, cast(c as bigint) as occurrences from r where n = 1")
def mention_upsert(spark, sf_dir):
    return i.from_evidence(_evidence(spark, sf_dir))[0]


@query(f"with {_EVIDENCE}, g as (select article, entity, s, e, min(text) as text from e group by all) select article, entity, cast(row_number() over (partition by article, entity order by s, e) as integer) as place, s as start, e as \"end\", text from g")
def occurrence_upsert(spark, sf_dir):
    return i.from_evidence(_evidence(spark, sf_dir))[1]


@query(
    "with q as (select c_custkey as query, 'n' || (c_custkey % 60) as name, md5('q' || (c_custkey % 90)) as fp from customer), l as (select 'n' || (s_suppkey % 80) as norm, s_suppkey // 2 as canonical from supplier), a as (select norm, min(canonical) as c from l group by 1 having count(distinct canonical) = 1),"
    " k as (select md5('q' || n_nationkey) as fp, n_name as result, case when n_nationkey % 3 > 0 then timestamp '2024-02-01' else timestamp '2024-01-01' end as x from nation)"
    " select query, coalesce(cast(c as varchar), result) as found, case when c is not null then 'label' when result is not null then 'cache' else 'miss' end as tier from q left join a on name = norm left join (select * from k where x > timestamp '2024-01-15') k on k.fp = q.fp"
)
def geocode_cache(spark, sf_dir):
    q = table(spark, sf_dir, "customer").selectExpr("c_custkey as query", "concat('n', c_custkey % 60) as name", "md5(concat('q', c_custkey % 90)) as fingerprint")
    labels = table(spark, sf_dir, "supplier").selectExpr("concat('n', s_suppkey % 80) as norm", "s_suppkey div 2 as canonical")
    cache = table(spark, sf_dir, "nation").selectExpr("md5(concat('q', n_nationkey)) as fingerprint", "n_name as result", "case when n_nationkey % 3 > 0 then timestamp '2024-02-01' else timestamp '2024-01-01' end as expires_at")
    return i.cached(q, labels, cache, F.to_timestamp(F.lit("2024-01-15")))
