"""Catalog queries: part names as labels with real duplicates, suppliers and customers as other catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import text
from tarnwick.operators import articles as a
from tarnwick.operators import catalog as c
from tarnwick.operators.graph import components
from tarnwick.queries import query
from tarnwick.session import table

_NORM = "lower(regexp_replace(trim(translate({0}, '‘’ʼ', '''''''')), '\\s+', ' ', 'g'))"
#: trigrams of a label: each word padded with two blanks before and one behind
_GRAMS = (
    "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda t: t <> ''),"
    " lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
)


@query(f"select p_partkey, {_NORM.format('p_name')} as norm, {_NORM.format('p_type')} as norm_type from part")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_text("p_name").alias("norm"), text.fold_key("p_type").alias("norm_type"))


@query("select s_suppkey, lower(trim(s_name)) as whole, split_part(lower(trim(s_name)), ' ', 1) as first_token, trim(split_part(lower(trim(replace(s_name, '#', ', '))), ',', 1)) as comma_head from supplier")
def block_keys(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.block_key("s_name").alias("whole"), text.block_key("s_name", "first_token").alias("first_token"), text.block_key(F.replace(F.col("s_name"), F.lit("#"), F.lit(", ")), "comma_head").alias("comma_head"))


@query(
    f"with n as (select distinct p_name, {_GRAMS.format('p_name')} as g from part), f as (select min(p_name) as q from part), q as (select q, {_GRAMS.format('q')} as h from f)"
    " select p_name, round(len(list_intersect(g, h)) / cast(len(list_distinct(list_concat(g, h))) as double), 6) as similarity from n, q"
)
def trigram_similarity(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    asked = table(spark, sf_dir, "part").agg(F.min("p_name").alias("q"))
    return names.join(F.broadcast(asked), how="cross").select("p_name", F.round(text.trigram_similarity("p_name", "q"), 6).alias("similarity"))


@query(
    "with t as (select distinct p_type, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x <> '')) as g from part)"
    " select a.p_type as a, b.p_type as b, round(len(list_intersect(a.g, b.g)) / cast(len(list_distinct(list_concat(a.g, b.g))) as double), 6) as score from t a join t b on a.p_type < b.p_type where len(list_intersect(a.g, b.g)) > 0"
)
def token_jaccard(spark, sf_dir):
    """Pairs of types that share a token, met by the token."""
    kinds = table(spark, sf_dir, "part").select("p_type").distinct().withColumn("t", text.tokens("p_type"))
    x = kinds.select(F.col("p_type").alias("a"), F.col("t").alias("ta"), F.explode("t").alias("token"))
    y = kinds.select(F.col("p_type").alias("b"), F.col("t").alias("tb"), F.explode("t").alias("token"))
    return x.join(y, "token").filter("a < b").select("a", "b", F.round(text.jaccard(F.col("ta"), F.col("tb")), 6).alias("score")).distinct()


@query(
    "with w as (select distinct p_type, list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda t: t <> '' and t not in ('a','an','and','at','by','for','in','of','on','the','to')) as w from part)"
    " select p_type, case when len(w) between 2 and 8 then upper(array_to_string(list_transform(w, lambda t: substr(t, 1, 1)), '')) end as acronym from w"
)
def acronym(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type").distinct().select("p_type", text.acronym("p_type").alias("acronym"))


@query(f"select {_NORM.format('p_name')} as norm, cast(min(p_partkey) as bigint) as first, cast(count(*) as bigint) as members from part group by 1 having count(*) > 1")
def dup_exact_clusters(spark, sf_dir):
    return c.exact_clusters(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query(
    f"with n as (select distinct s_name as label, {_GRAMS.format('s_name')} as g from supplier)"
    " select a.label as a, b.label as b, round(len(list_intersect(a.g, b.g)) / cast(len(list_distinct(list_concat(a.g, b.g))) as double), 6) as similarity from n a join n b on a.label < b.label"
    " where len(list_intersect(a.g, b.g)) / cast(len(list_distinct(list_concat(a.g, b.g))) as double) >= 0.72"
)
def dup_near_pairs(spark, sf_dir):
    pairs = c.near_pairs(table(spark, sf_dir, "supplier"), "s_name", F.lit("supplier"))
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


_KEYED = """keyed as (
  select distinct s_suppkey as id, 'nation:' || s_nationkey as key from supplier
  union select s_suppkey, 'balance:' || cast(floor(s_acctbal / 100) as bigint) from supplier
  union select s_suppkey, 'exact:' || (s_suppkey % 7) from supplier
)"""


def keyed(spark, sf_dir):
    keys = F.array(F.concat(F.lit("nation:"), "s_nationkey"), F.concat(F.lit("balance:"), F.floor(F.col("s_acctbal") / 100).cast("long")), F.concat(F.lit("exact:"), (F.col("s_suppkey") % 7).cast("string")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(keys).alias("key"))


@query(f"with {_KEYED}, s as (select key from keyed group by 1 having count(*) > 1 and (count(*) <= 250 or starts_with(key, 'exact:'))), u as (select * from keyed where key in (select key from s)) select distinct a.id as a, b.id as b from u a join u b using (key) where a.id < b.id")
def blocking_pairs(spark, sf_dir):
    return c.blocking_pairs(keyed(spark, sf_dir), "id")[0]


@query(
    f"with {_KEYED}, every as (select 'supplier' as catalog, id, key from keyed union all select 'customer', c_custkey, 'segment:' || c_mktsegment from customer union all select 'customer', c_custkey, 'nation:' || c_nationkey from customer)"
    " select catalog, key, cast(count(*) as bigint) as size from every group by 1, 2 having count(*) > 8 and not starts_with(key, 'exact:')"
)
def blocking_skipped(spark, sf_dir):
    """Keys of suppliers and customers with more ids than pairs are formed for where eight are the most."""
    of_customers = F.array(F.concat(F.lit("segment:"), "c_mktsegment"), F.concat(F.lit("nation:"), "c_nationkey"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(of_customers).alias("key"))
    skipped = lambda rows, catalog: c.blocking_pairs(rows, "id", cap=8)[1].select(F.lit(catalog).alias("catalog"), "key", "size")
    return skipped(keyed(spark, sf_dir), "supplier").unionByName(skipped(customers, "customer"))


@query(f"with {_KEYED}, s as (select key from keyed group by 1 having count(*) > 1 and (count(*) <= 250 or starts_with(key, 'exact:'))), u as (select * from keyed where key in (select key from s)), p as (select distinct a.id as a, b.id as b from u a join u b using (key) where a.id < b.id) select a, b, least(cast(a as varchar), cast(b as varchar)) || '|' || greatest(cast(a as varchar), cast(b as varchar)) as pair_key from p where (a + b) % 3 <> 0")
def dismissed_pairs(spark, sf_dir):
    pairs = c.blocking_pairs(keyed(spark, sf_dir), "id")[0]
    dismissed = pairs.filter((F.col("a") + F.col("b")) % 3 == 0).select(c.pair_key("a", "b").alias("pair_key"))
    return c.without_dismissed(pairs, dismissed).select("a", "b", "pair_key")


@query(
    "with recursive e as (select distinct o_custkey as a, -l_suppkey as b from orders join lineitem on o_orderkey = l_orderkey where l_quantity >= 49 and l_discount >= 0.09),"
    " u as (select a as x, b as y from e union select b, a from e), r as (select distinct x as node, x as root from u union select u.y, r.root from r join u on u.x = r.node) select cast(node as bigint) as node, cast(min(root) as bigint) as root from r group by 1"
)
def connected_components(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49 and l_discount >= 0.09")
    orders = table(spark, sf_dir, "orders")
    edges = orders.join(item, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), (-F.col("l_suppkey")).alias("b"))
    return components(edges)


@query("select distinct c_name as label, lower(c_name) as norm from customer where lower(replace(c_name, 'Customer', 'Supplier')) in (select lower(s_name) from supplier)")
def cross_catalog_collision(spark, sf_dir):
    labels = table(spark, sf_dir, "customer").select(F.col("c_name").alias("label"), F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier")).alias("as_supplier"))
    return c.collisions(labels, "as_supplier", table(spark, sf_dir, "supplier"), "s_name").select("label", F.lower("label").alias("norm")).distinct()


@query(
    "with s as (select p_partkey, (case when regexp_matches(p_name, '[0-9]') then 2 else 0 end + case when not regexp_matches(p_name, '[A-Za-z]') then 4 else 0 end + case when length(trim(p_name)) < 4 then 2 else 0 end"
    " + case when length(trim(p_name)) > 60 then 2 else 0 end + case when regexp_matches(p_name, '^[^a-z]*[A-Z][^a-z]*$') then 1 else 0 end + case when regexp_matches(p_name, '[#@<>{}|]') then 3 else 0 end"
    " + case when regexp_matches(lower(p_name), '\\b(unknown|various|other|n/a|none|test)\\b') then 4 else 0 end) as points from (select p_partkey, p_brand || ' ' || p_name as p_name from part)) select p_partkey, cast(points as bigint) as points from s where points >= 2"
)
def questionable_score(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("label"))
    return rows.withColumn("points", c.questionable("label")).filter("points >= 2").select("p_partkey", "points")


@query(
    "with l as (select l_suppkey, p_name, s_name from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"
    " select l_suppkey, cast(count(*) as bigint) as mismatches, array_to_string(list_sort(list(distinct p_name))[1:3], '; ') as examples from l"
    " where len(list_intersect(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), regexp_split_to_array(lower(s_name), '[^a-z0-9]+'))) = 0 group by 1"
)
def mismatch_examples(spark, sf_dir):
    linked = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return c.mismatches(linked, "l_suppkey", "p_name", "s_name")


@query("with s as (select l_suppkey, cast(count(distinct l_partkey) as bigint) as links, cast(count(*) as bigint) as mentions from lineitem group by 1), j as (select s_nationkey, s_suppkey, links, mentions from s join supplier on l_suppkey = s_suppkey) select s_nationkey, s_suppkey as keeper, links, mentions from (select *, row_number() over (partition by s_nationkey order by links desc, mentions desc, s_suppkey) as n from j) where n = 1")
def keeper_pick(spark, sf_dir):
    size = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("links"), F.count("*").alias("mentions"))
    rows = size.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return a.per_group(rows, ["s_nationkey"], [F.desc("links"), F.desc("mentions"), F.col("s_suppkey")], 1).select("s_nationkey", F.col("s_suppkey").alias("keeper"), "links", "mentions")
