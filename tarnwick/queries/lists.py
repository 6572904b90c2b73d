"""List requests, editorial lists, persists by policy and check runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import articles as a
from tarnwick.operators import catalog as c
from tarnwick.operators import duplicates as d
from tarnwick.operators import ingest as i
from tarnwick.operators import runs
from tarnwick.queries import query
from tarnwick.session import table


@query(
    "with a as (select o_orderkey, nullif(o_orderdate, (select min(o_orderdate) from orders)) as day from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')),"
    " down as (select 'down' as request, o_orderkey, row_number() over (order by day desc nulls last, o_orderkey desc) as place from a), up as (select 'up' as request, o_orderkey, row_number() over (order by day nulls first, o_orderkey) as place from a)"
    " select request, o_orderkey from down where place <= 30 union all select request, o_orderkey from up where place <= 30"
)
def section_page(spark, sf_dir):
    """A section asked for in the default order, and from the oldest up, where articles without a date come first."""
    orders = table(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_orderdate").alias("first"))
    articles = orders.join(F.broadcast(first), how="cross").select("o_orderkey", F.nullif("o_orderdate", F.col("first")).alias("day"))
    meta = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("topic").alias("meta_type"), F.col("l_returnflag").alias("category"))
    ask = lambda name, **more: a.listed(articles, meta, "o_orderkey", "day", {"section": " R ", "limit": 30} | more).select(F.lit(name).alias("request"), "o_orderkey")
    return ask("down").unionByName(ask("up", direction="asc"))


@query(
    "with m as (select l_partkey as id, l_returnflag as nature, l_linenumber as project from lineitem where l_linenumber in (1, 2)), al as (select p_partkey as id, p_type as alias from part)"
    " select p_partkey as id, p_name as label from part where p_brand = 'Brand#3' and (contains(lower(p_name), 'ring') or p_partkey in (select id from al where contains(lower(alias), 'econ')))"
    " and p_partkey in (select id from m where nature in ('R', 'A')) and p_partkey in (select id from m group by id having count(*) >= 5)"
)
def canonical_list(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    canonicals = part.selectExpr("p_partkey as id", "p_name as label", "p_brand as kind")
    mentions = table(spark, sf_dir, "lineitem").selectExpr("l_partkey as canonical", "l_returnflag as nature", "l_linenumber as project")
    found = a.canonical_list(canonicals, part.selectExpr("p_partkey as canonical", "p_type as alias"), mentions, part=" ring", kind="Brand#3", natures=["R", "A"], projects=[1, 2], least=5)
    econ = a.canonical_list(canonicals, part.selectExpr("p_partkey as canonical", "p_type as alias"), mentions, part="ECON", kind="Brand#3", natures=["R", "A"], projects=[1, 2], least=5)
    return found.unionByName(econ).distinct().select("id", "label")


@query("with f as (select l_orderkey, l_returnflag, min(l_linenumber) as n from lineitem group by 1, 2) select l_orderkey, l_returnflag, cast(row_number() over (partition by l_orderkey order by n, l_returnflag) as integer) as place from f")
def first_seen_values(spark, sf_dir):
    return a.first_seen(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", ["l_linenumber"])


_VALUES = (
    "o as (select o_orderkey as article, o_orderstatus as kind, o_orderpriority as value, cast(o_custkey % 10 as double) as confidence, o_custkey % 4 = 0 as edited from orders where o_orderkey % 3 > 0),"
    " b as (select article, kind, value, confidence from (select *, row_number() over (partition by article, kind order by confidence desc nulls last, value) as n from (select o_orderkey as article, o_orderstatus as kind, case when l_linenumber % 2 = 0 then o_orderpriority else l_returnflag end as value,"
    " cast(o_custkey % 10 + l_linenumber % 2 as double) as confidence from orders join lineitem on o_orderkey = l_orderkey where o_orderkey % 4 > 0)) where n = 1)"
)


def _values(policy):
    fixed = {"add_only": "o.article is not null", "smart_merge": "o.article is not null and coalesce(edited, false)", "replace": "false"}[policy]
    stays = f"o.article is not null and (b.article is null or {fixed})"
    return (
        f"select '{policy}' as policy, coalesce(o.article, b.article) as article, coalesce(o.kind, b.kind) as kind, case when {stays} then o.value else b.value end as value, case when {stays} then o.confidence else b.confidence end as confidence,"
        f" case when o.article is null then 'inserted' when b.article is null then 'kept' when {fixed} then 'skipped' when o.value = b.value and o.confidence = b.confidence then 'unchanged' else 'changed' end as action from o full join b on o.article = b.article and o.kind = b.kind"
    )


@query(f"with {_VALUES} " + " union all ".join(map(_values, ("add_only", "smart_merge", "replace"))))
def metadata_persist(spark, sf_dir):
    """One value for each article and type, brought by a batch under each policy."""
    orders, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    stored = orders.filter("o_orderkey % 3 > 0").selectExpr("o_orderkey as article", "o_orderstatus as kind", "o_orderpriority as value", "cast(o_custkey % 10 as double) as confidence", "o_custkey % 4 = 0 as edited")
    batch = orders.filter("o_orderkey % 4 > 0").join(item, F.col("o_orderkey") == F.col("l_orderkey"))
    batch = batch.selectExpr("o_orderkey as article", "o_orderstatus as kind", "case when l_linenumber % 2 = 0 then o_orderpriority else l_returnflag end as value", "cast(o_custkey % 10 + l_linenumber % 2 as double) as confidence")
    out = None
    for policy in ("add_only", "smart_merge", "replace"):
        one = i.persist_values(stored, batch, ["article", "kind"], policy).withColumn("policy", F.lit(policy))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "with s as (select l_orderkey as article, l_returnflag as record_type, l_linenumber as record_index, 'old' as fields from lineitem where l_quantity < 30), b as (select l_orderkey as article, l_returnflag as record_type, l_linenumber as record_index, min('new ' || l_suppkey) as fields from lineitem where l_quantity >= 20 group by 1, 2, 3),"
    " added as (select * from s union all select * from b where (article, record_type) not in (select (article, record_type) from s)), replaced as (select * from b union all select * from s where (article, record_type) not in (select (article, record_type) from b))"
    " select 'add_only' as policy, * from added union all select 'replace', * from replaced"
)
def custom_record_persist(spark, sf_dir):
    """Whole sets of records of an article and type, under both policies."""
    item = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as article", "l_returnflag as record_type", "l_linenumber as record_index", "l_quantity", "l_suppkey")
    stored = item.filter("l_quantity < 30").select("article", "record_type", "record_index", F.lit("old").alias("fields"))
    batch = item.filter("l_quantity >= 20").select("article", "record_type", "record_index", F.concat(F.lit("new "), "l_suppkey").alias("fields"))
    sides = [i.persist_sets(stored, batch, ["article", "record_type"], "record_index", p).withColumn("policy", F.lit(p)) for p in ("add_only", "replace")]
    return sides[0].unionByName(sides[1])


@query(
    "with o as (select vec_id, label, embedding from embeddings where vec_id % 3 > 0), b as (select vec_id, label, list_transform(embedding, lambda x: cast(x * 2 as float)) as embedding from embeddings where vec_id % 4 > 0)"
    " select coalesce(o.vec_id, b.vec_id) as vec_id, case when o.vec_id is null then 'inserted' when b.vec_id is null then 'kept' else 'changed' end as action, round(cast(list_extract(coalesce(b.embedding, o.embedding), 1) as double), 5) as first from o full join b on o.vec_id = b.vec_id"
)
def embedding_persist(spark, sf_dir):
    """One vector for each article, replaced where a batch brings another."""
    v = table(spark, sf_dir, "embeddings")
    stored = v.filter("vec_id % 3 > 0").selectExpr("vec_id", "embedding as value", "1.0D as confidence", "false as edited")
    batch = v.filter("vec_id % 4 > 0").selectExpr("vec_id", "transform(embedding, x -> cast(x * 2 as float)) as value", "1.0D as confidence")
    return i.persist_values(stored, batch, ["vec_id"], "replace").select("vec_id", "action", F.round(F.get("value", F.lit(0)).cast("double"), 5).alias("first"))


@query(
    "with c as (select event_id as id, user_id as scope, event_type as check_name, ts, case when event_id % 5 < 2 then 'failed' else 'done' end as status from events)"
    " select scope, check_name, id, status from (select *, row_number() over (partition by scope, check_name order by ts desc, id desc) as n from c where status = 'done') where n = 1"
)
def latest_check_runs(spark, sf_dir):
    """The newest finished run of every check in every scope."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id as id", "user_id as scope", "event_type as check", "ts as created_at", "case when event_id % 5 < 2 then 'failed' else 'done' end as status")
    return runs.latest_check(rows, "done").select("scope", F.col("check").alias("check_name"), "id", "status")


@query(
    "with m as (select p_partkey as id, p_type || ' ' || p_size as cluster_name, p_name as label from part), g as (select cluster_name, min(id) as cluster, count(*) as size, count(distinct label) as labels, min(label) as least, arg_min(label, id) as own from m group by 1 having count(*) > 1)"
    " select cluster, cast(size as bigint) as size, labels = 1 as exact, case when labels = 1 then least else own end as label, cast(row_number() over (order by (labels = 1) desc, size desc, case when labels = 1 then least else own end, cluster) as bigint) as ordinal from g"
)
def cluster_order(spark, sf_dir):
    """Groups of parts of one type and size in the order of a review list."""
    part = table(spark, sf_dir, "part")
    groups = part.groupBy("p_type", "p_size").agg(F.min("p_partkey").alias("cluster"), F.count("*").alias("size")).filter("size > 1")
    members = part.join(groups, ["p_type", "p_size"]).selectExpr("cluster", "p_partkey as id", "p_name as label")
    return d.ordered(groups.select("cluster", "size"), members)


@query("with c as (select l_orderkey, sum(l_tax) as cost from lineitem where l_returnflag = 'R' group by 1) select o_orderkey, round(cost, 6) as cost from orders left join c on o_orderkey = l_orderkey order by round(cost, 6) desc nulls last, o_orderkey limit 50")
def items_by_cost(spark, sf_dir):
    """Items with the cost of their calls as the key of the order; items without any come last."""
    cost = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_tax"), 6).alias("cost"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(cost, "o_orderkey", "left")
    return a.page(rows, [F.desc_nulls_last("cost"), F.col("o_orderkey")], 50)


_LABEL = "case c_custkey % 7 when 0 then 'Supplier#' || lpad(cast(c_custkey as {0}), 9, '0') when 1 then 'Anna School ' || c_custkey when 2 then 'CBS' when 3 then 'police spokesperson ' || c_custkey when 4 then 'Bankole Unions' when 5 then 'Union Bank of Red Cross' else 'NASA' end"


@query(
    "with p as (select c_custkey as id, " + _LABEL.format("varchar") + " as label, case when c_nationkey % 2 = 0 then ' Media_Journalism' else 'resident' end as kind from customer), o as (select s_name, case when s_nationkey % 2 = 0 then 'court' else 'fan_club' end as org from supplier),"
    " s as (select id, label, kind, org, id % 7 as k from p left join o on lower(label) = lower(s_name)), t as (select id, org, list_filter([case when org is not null then 'cross_catalog_organization' end, case when org = 'court' then 'matching_institutional_org_type' end,"
    " case when k = 5 then 'association_civic_body' end, case when k = 5 then 'company_financial_institution' end, case when k = 1 then 'school_university' end, case when k = 5 then 'healthcare_public_health' end, case when k = 3 then 'government_agency_office' end,"
    " case when k = 2 then 'media_outlet' end, case when k = 3 then 'role_phrase_without_person_name' end, case when k in (2, 6) then 'all_caps_acronym' end], lambda x: x is not null) as g, kind <> 'resident' as office, k from s),"
    " q as (select id, org, k, office and len(g) > 0 as plus, array_to_string(g, ',') as g, case when org is not null then 5 else 0 end + case when org = 'court' then 2 else 0 end + case k when 1 then 4 when 2 then 5 when 3 then 7 when 5 then 12 when 6 then 2 else 0 end as points from t)"
    " select id, cast(points + plus::int as integer) as score, case when plus then g || ',person_type_surface_mismatch' else g end as signals, case when points + plus::int >= 7 or org is not null then 'high' else 'medium' end as confidence,"
    " case when org is not null or k not in (2, 6) then 'organization' else 'unknown' end as suggested from q where points + plus::int >= 4"
)
def questionable_people(spark, sf_dir):
    """Customers under names of people, companies and offices, beside suppliers as organizations."""
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", f"{_LABEL.format('string')} as label", "case when c_nationkey % 2 = 0 then ' Media_Journalism' else 'resident' end as kind")
    organizations = table(spark, sf_dir, "supplier").selectExpr("s_name as label", "case when s_nationkey % 2 = 0 then 'court' else 'fan_club' end as kind")
    return c.questionable_people(people, organizations)


@query(
    "with m as (select l_partkey as entity, l_suppkey as canonical, 'part ' || l_partkey as name, 'part ' || (l_partkey + l_suppkey % 2) as label from lineitem), a as (select s_suppkey as canonical, 'part ' || s_suppkey as alias from supplier),"
    " x as (select m.* from m where not exists (select 1 from a where a.canonical = m.canonical and a.alias = m.name)) select canonical, cast(count(*) as bigint) as mismatches from x where name <> label group by 1"
)
def mismatches_but_aliases(spark, sf_dir):
    """Linked names unlike their canonical's label, without those that an editor gave it as alias."""
    linked = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as canonical", "concat('part ', l_partkey) as name", "concat('part ', l_partkey + l_suppkey % 2) as label")
    aliases = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as canonical", "concat('PART  ', s_suppkey) as alias")
    unlike = c.not_aliased(linked, aliases, "canonical", "name").filter("name != label")
    return unlike.groupBy("canonical").agg(F.count("*").alias("mismatches"))
