"""Name, duplicate, connection and run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import places, text, udfs
from tarnwick.operators import catalog
from tarnwick.operators import connections as k
from tarnwick.operators import duplicates as d
from tarnwick.operators import runs
from tarnwick.queries import query
from tarnwick.session import spread, table

_PLACE = "case p_partkey % 4 when 0 then 'Ward ' || p_size || ', Chicago, IL 60601' when 1 then p_size || 'th Precinct, Boston, MA, USA' when 2 then 'District No. ' || p_size || ', Paris' else 'North ' || p_name end"


def _places(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_PLACE.replace('||', '||')} as place")


@query(f"select p_partkey, case p_partkey % 4 when 0 then 'ward' when 1 then 'precinct' when 2 then 'district' end as kind, case when p_partkey % 4 < 3 then cast(p_size as integer) end as number from part")
def district_identity(spark, sf_dir):
    found = places.district("place")
    return _places(spark, sf_dir).select("p_partkey", found["kind"].alias("kind"), found["number"].alias("number"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'chicago' when 1 then 'boston' end as city, case p_partkey % 4 when 0 then 'illinois' when 1 then 'massachusetts' end as state, case when p_partkey % 4 < 2 then 'us' end as country from part")
def jurisdiction_tail(spark, sf_dir):
    found = places.jurisdiction("place")
    return _places(spark, sf_dir).select("p_partkey", found["city"].alias("city"), found["state"].alias("state"), found["country"].alias("country"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'ward ' || p_size || ' chicago il 60601' when 1 then p_size || ' precinct boston ma usa' when 2 then 'district no ' || p_size || ' paris' else 'north ' || p_name end as loose from part")
def loose_keys(spark, sf_dir):
    return _places(spark, sf_dir).select("p_partkey", places.loose_key("place").alias("loose"))


@query("with n as (select distinct p_name from part) select a.p_name as a, b.p_name as b, length(least(a.p_name, b.p_name)) >= 0 and contains('the ' || b.p_name || ' of chicago', a.p_name) and length(a.p_name) >= 10 and length(a.p_name) >= 0.55 * length('the ' || b.p_name || ' of chicago') as part from n a join n b on split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1)")
def contained_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    head = F.split_part("p_name", F.lit(" "), F.lit(1))
    a, b = names.select(F.col("p_name").alias("a"), head.alias("head")), names.select(F.col("p_name").alias("b"), head.alias("head"))
    rows = a.join(b, "head").withColumn("long", F.concat(F.lit("the "), "b", F.lit(" of chicago")))
    return rows.select("a", "b", places.contained("a", "long").alias("part"))


@query("select distinct p_name, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' of the USA ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) as shown from part")
def display_case(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", places.display(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("OF The USA"), F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("shown"))


@query(
    "with e as (select s_suppkey as id, case s_suppkey % 3 when 0 then 'The River Museum ' || (s_suppkey // 6) when 1 then 'Museum River ' || (s_suppkey // 6) else 'Harbor Trust ' || s_suppkey end as label, s_suppkey // 6 as n, s_suppkey % 3 as kind from supplier),"
    " r as (select min(id) as id, n, kind from e where kind < 2 group by n, kind)"
    " select a.id as a, b.id as b, 0.95 as score from r a join r b using (n) where a.id < b.id"
    " union all select r.id, e.id, 1.0 from e join r using (n, kind) where e.id > r.id"
)
def organization_duplicates(spark, sf_dir):
    """Pairs between representatives of equal labels, and each other row with its representative."""
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "case s_suppkey % 3 when 0 then concat('The River Museum ', s_suppkey div 6) when 1 then concat('Museum River ', s_suppkey div 6) else concat('Harbor Trust ', s_suppkey) end as label")
    return d.organization_pairs(rows).select("a", "b", F.round("score", 6).alias("score"))


@query(
    "with e as (select c_custkey as id, c_custkey // 4 as n, c_custkey % 4 as kind from customer), p as (select a.id as a, b.id as b from e a join e b on a.n = b.n and a.id < b.id where a.kind < 3 and b.kind < 3)"
    " select n as nth, cast(min(id) as bigint) as cluster, cast(count(*) as bigint) as size from e where kind < 3 group by 1 having count(*) > 1"
)
def person_duplicates(spark, sf_dir):
    """Three spellings of a name in every four customers; the fourth has another suffix."""
    letters = "translate(cast(c_custkey div 4 as string), '0123456789', 'abcdefghij')"
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", f"case c_custkey % 4 when 0 then concat('Anna ', {letters}, 'son') when 1 then concat('anna  ', {letters}, 'son') when 2 then concat('ANNA ', {letters}, 'SON') else concat('Anna ', {letters}, 'son Jr') end as label")
    found = d.clusters(d.person_pairs(rows))
    return found.select(F.expr("cluster div 4").alias("nth"), "cluster", "size")


@query(
    "with c as (select o_orderkey as article, 'customer' as from_type, o_custkey as from_id, 'supplier' as to_type, l_suppkey as to_id, case when l_linenumber % 2 = 0 then 'buys' else 'visits' end as nature, 1 - l_discount as confidence, case when l_quantity < 45 then 'q' || l_linenumber end as quote from orders join lineitem on o_orderkey = l_orderkey),"
    " b as (select *, row_number() over (partition by article, from_id, to_id, nature order by confidence desc, quote) as n from c where confidence >= 0.9 and quote is not null and nature = 'buys'), t as (select *, row_number() over (partition by article order by confidence desc, from_id, to_id) as k from b where n = 1)"
    " select article, from_id, to_id, round(confidence, 4) as confidence, quote from t where k <= 20"
)
def auto_connections(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_quantity")
    # dealt once by the article: the join and both choices within it stay where they are
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(spread(item, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    proposed = rows.selectExpr(
        "o_orderkey as article", "'customer' as from_type", "o_custkey as from_id", "'supplier' as to_type", "l_suppkey as to_id", "case when l_linenumber % 2 = 0 then 'buys' else 'visits' end as nature", "1 - l_discount as confidence", "case when l_quantity < 45 then concat('q', l_linenumber) end as quote"
    )
    rules = spark.createDataFrame([("customer", "supplier", "buys")], "from_type string, to_type string, nature string")
    return k.valid(proposed, rules).select("article", "from_id", "to_id", F.round("confidence", 4).alias("confidence"), "quote")


@query("select c_custkey as person, s_suppkey as organization from customer join supplier on s_suppkey = c_custkey // 7 where c_custkey % 5 <> 0")
def affiliation_edges(spark, sf_dir):
    """Customers whose affiliation holds all tokens of a supplier's name, among all suppliers."""
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey as person", "concat('agent of the ', case when c_custkey % 5 = 0 then 'Supplier' else concat('SUPPLIER ', lpad(cast(c_custkey div 7 as string), 9, '0')) end, ' office') as affiliation")
    named = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as organization", "s_name as label")
    return k.affiliations(people, named)


@query("select s_suppkey as a, n_nationkey as b from supplier join nation on s_nationkey = n_nationkey")
def same_site_hints(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "concat('Place ', s_nationkey, ', office ', s_suppkey) as label")
    b = table(spark, sf_dir, "nation").selectExpr("n_nationkey as id", "concat('PLACE  ', n_nationkey, ', yard') as label")
    return k.same_head(a, b)


@query(
    "with p as (select c_custkey as id, c_custkey // 8 as doc, 'spot ' || (c_custkey % 2) as name, c_nationkey % 2 as family, c_custkey % 3 = 0 as has_id, (c_custkey % 5) * 0.001 as lon, case when c_acctbal > 4000 then 'resolved' else 'review' end as state from customer)"
    " select a.id as a, b.id as b from p a join p b on a.doc = b.doc and a.name = b.name and a.family = b.family and a.id < b.id where (a.has_id and b.has_id) or a.state <> b.state or 2 * 6371000 * asin(least(1.0, abs(sin(radians(b.lon - a.lon) / 2)))) <= 300"
)
def place_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "c_custkey div 8 as doc", "concat('Spot ', c_custkey % 2) as name", "c_nationkey % 2 as family", "'us' as jurisdiction", "case when c_custkey % 3 = 0 then 'x' end as identity", "(c_custkey % 5) * 0.001D as lon", "0.0D as lat", "case when c_acctbal > 4000 then 'resolved' else 'review' end as state"
    )
    return k.place_groups(rows)


@query(
    "with q as (select p_partkey, case p_partkey % 3 when 0 then 'address' when 1 then 'state' else 'city' end as ak, case p_partkey % 2 when 0 then 'city' else 'state' end as fk, p_size % 4 as a_s, p_size % 5 as f_s, p_size % 2 as a_c, p_size % 3 as f_c from part)"
    " select p_partkey, array_to_string(list_filter([case when ak = 'address' and fk = 'city' then 'city_fallback' end, case when a_s <> f_s then 'region_mismatch' end, case when a_s = f_s and a_c <> f_c then 'subnational_mismatch' end, case when ak = 'state' and fk <> 'state' then 'level_mismatch' end], lambda x: x is not null), ',') as flags from q"
)
def geocode_qa(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "case p_partkey % 3 when 0 then 'address' when 1 then 'state' else 'city' end as ak", "case p_partkey % 2 when 0 then 'city' else 'state' end as fk", "cast(p_size % 4 as string) as s1", "cast(p_size % 5 as string) as s2", "cast(p_size % 2 as string) as c1", "cast(p_size % 3 as string) as c2"
    )
    return rows.select("p_partkey", k.qa_flags("ak", "fk", "s1", "s2", "c1", "c2").alias("flags"))


_DUE = "event_id % 4 = 0 and ts < timestamp '2024-01-15'"


@query(f"select event_id, case when {_DUE} then 'delivering' else 'pending' end as state, cast(event_id % 3 + case when {_DUE} then 1 else 0 end as integer) as attempts, case when {_DUE} then 'w1' end as owner from events")
def claim_deliveries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "ts", "'pending' as state", "cast(event_id % 3 as int) as attempts", "cast(null as timestamp) as lease_until", "cast(null as string) as owner")
    due = rows.filter("event_id % 4 = 0 and ts < timestamp_ntz '2024-01-15'")
    return runs.claim(rows, due, "event_id", F.to_timestamp(F.lit("2024-01-31")), "w1").select("event_id", "state", "attempts", "owner")


@query("select event_id, case when event_id % 2 = 0 and ts < timestamp '2024-01-15' - interval 18 minute then 'pending' when event_id % 2 = 0 then 'running' else 'succeeded' end as status from events")
def reclaim_stale(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "case when event_id % 2 = 0 then 'running' else 'succeeded' end as status", "cast(ts as timestamp) as started_at")
    return runs.reclaim(rows, F.to_timestamp(F.lit("2024-01-15"))).select("event_id", "status")


@query("with s as (select o_custkey, count(*) filter (o_orderstatus = 'P') as op, count(*) filter (o_orderstatus = 'F') as bad, count(*) filter (o_orderstatus = 'O') as good from orders group by 1) select o_custkey, case when op > 0 then 'running' when bad = 0 then 'succeeded' when good = 0 then 'failed' else 'partial' end as state from s")
def batch_finalise(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey", "case o_orderstatus when 'P' then 'pending' when 'F' then 'failed' else 'succeeded' end as status")
    return runs.final_state(rows, "o_custkey", "status")


@query("with t as (select l_orderkey as article, l_suppkey as item, 0 as r from lineitem where l_returnflag = 'R' union all select l_orderkey, l_suppkey, 1 from lineitem where l_quantity > 25 union all select l_orderkey, l_suppkey, 2 from lineitem) select article, item, case min(r) when 0 then 'key' when 1 then 'source' else 'json' end as via from t group by 1, 2")
def processing_history(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article"), F.col("l_suppkey").alias("item"), "l_returnflag", "l_quantity")
    return runs.history(item.filter("l_returnflag = 'R'"), item.filter("l_quantity > 25"), item)


@query("select p_partkey, replace(p_name, ' ', '-') || case when n = 1 then '' else '-' || n end as slug from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as n from part)")
def slug_allocation(spark, sf_dir):
    return runs.slugs(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query("select s_suppkey, sha256('suppliers') as scope_hash, cast(row_number() over (order by s_acctbal desc, s_suppkey) as integer) as ordinal from supplier where s_acctbal > 0")
def stored_check(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    return runs.stored_check(rows, [F.desc("s_acctbal"), F.col("s_suppkey")], "suppliers").select("s_suppkey", "scope_hash", "ordinal")


@query("with t as (select distinct conv_id, substr(trim(text), 1, 220) as t from conversations where trim(text) <> ''), n as (select *, row_number() over (partition by conv_id order by t) as n from t) select conv_id, string_agg(t, ' | ' order by t) as samples from n where n <= 3 group by 1")
def sample_mentions(spark, sf_dir):
    return runs.sample_texts(table(spark, sf_dir, "conversations"), "conv_id", "text")


@query("select user_id, cast(epoch(timestamp '2024-01-31') - floor(epoch(min(ts))) as bigint) as waits_s from events where event_type = 'click' group by 1")
def oldest_pending(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "click", "pending"))
    return runs.oldest(rows, ["user_id"], "status", "ts", F.to_timestamp(F.lit("2024-01-31")))


@query()
def sequence_ratio(spark, sf_dir):
    """Ratcliff-Obershelp has no SQL: it ranks the near names of suppliers, which meet by their rare trigrams."""
    near = catalog.near_pairs(table(spark, sf_dir, "supplier"), "s_name", F.lit("supplier"))
    return near.select("a", "b", F.round(udfs.sequence_ratio("a", "b"), 6).alias("ratio"))


_KEY = "list_transform(range(1, 65), lambda i: coalesce(ascii(nullif(substr(secret, i, 1), '')), 0))"
_PAD = "unhex(array_to_string(list_transform(k, lambda b: printf('%02x', xor(b, {0}))), ''))"


@query(
    f"with s as (select event_id, 's' || user_id as secret, cast(floor(epoch(ts)) as bigint) || '.' || props as body from events), k as (select event_id, body, {_KEY} as k from s)"
    f" select event_id, sha256({_PAD.format(92)} || unhex(sha256({_PAD.format(54)} || encode(body)))) as signature from k"
)
def signed_deliveries(spark, sf_dir):
    """Each event's body signed with its user's secret."""
    rows = table(spark, sf_dir, "events").withColumn("secret", F.concat(F.lit("s"), F.col("user_id").cast("string"))).withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"))
    return rows.select("event_id", text.signature("secret", "at", "props").alias("signature"))


@query("with d as (select doc_id, label, v.vec_id from documents join embeddings v on doc_id = v.vec_id where lang = 'en'), q as (select embedding e from embeddings where vec_id = 1) select d.doc_id, round(list_cosine_similarity(cast(embedding as double[]), cast(e as double[])), 5) as score from d join embeddings v on d.vec_id = v.vec_id, q order by score desc, d.doc_id desc limit 15")
def semantic_articles(spark, sf_dir):
    """Documents with an embedding, most similar first; ties by the later id."""
    from tarnwick.functions import vectors
    from tarnwick.operators.articles import page

    docs = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    vec = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vec.filter("vec_id = 1").select(F.col("embedding").alias("e"))
    rows = docs.join(vec, "vec_id").join(F.broadcast(asked), how="cross").select(F.col("vec_id").alias("doc_id"), F.round(vectors.cosine("embedding", "e"), 5).alias("score"))
    return page(rows, [F.desc("score"), F.desc("doc_id")], 15)


@query("with e as (select user_id, event_type, ts from events), m as (select user_id, min(ts) as first_ts from e group by 1) select cast(count(*) as bigint) as users, cast(count(*) filter (first_ts < timestamp '2024-01-02') as bigint) as early, cast((select count(distinct event_type) from e) as bigint) as types from m")
def project_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first = events.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    sums = first.agg(F.count("*").alias("users"), F.count(F.when(F.col("first_ts") < F.lit("2024-01-02").cast("timestamp_ntz"), 1)).alias("early"))
    return sums.join(F.broadcast(events.agg(F.count_distinct("event_type").alias("types"))), how="cross")
