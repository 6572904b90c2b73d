"""Queries of reconciled names: the heads of sentences stand for what a model would extract, the same way in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import reconcile as r
from tarnwick.queries import query
from tarnwick.session import table

_HEADS = "[A-Z][a-z]{2,} [a-z]{2,}"
# every third head names a surname alone, the others a given and a family name
_PEOPLE = f"""
with recursive h as (
  select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as start from (select doc_id, regexp_extract_all(text, '{_HEADS}') as w from documents)
), c as (
  select doc_id, start, case when start % 3 = 0 then f else split_part(w, ' ', 1) || ' ' || f end as name,
    case when start % 3 <> 0 then lower(split_part(w, ' ', 1)) end as given, lower(f) as family
  from (select *, upper(left(split_part(w, ' ', 2), 1)) || substr(split_part(w, ' ', 2), 2) as f from h)
), n as (
  select *, case when family in ('jr', 'sr', 'ii', 'iii', 'iv', 'v', 'md', 'phd', 'esq') then 1 else 0 end as suffix from c
), k as (
  select doc_id, start, name, case when suffix = 0 then given end as given, case when suffix = 0 then family else given end as family, case when given is null then 1 else 2 end as n from n
), fold as (
  select doc_id, cast(0 as bigint) as pos, cast([] as struct(name varchar, given varchar, family varchar, key varchar, n integer, starts bigint[])[]) as clusters, 0 as unresolved from (select distinct doc_id from k)
  union all
  select doc_id, pos, case
      when len(hits) = 1 then list_transform(clusters, lambda x, i: case when i = hits[1] then
        struct_pack(name := case when n > x.n then name else x.name end, given := case when n > x.n then given else x.given end, family := case when n > x.n then family else x.family end,
          key := case when n > x.n then lower(name) else x.key end, n := greatest(n, x.n), starts := list_append(x.starts, pos)) else x end)
      when n = 1 then clusters
      else list_append(clusters, struct_pack(name := name, given := given, family := family, key := lower(name), n := n, starts := [pos])) end,
    unresolved + case when len(hits) <> 1 and n = 1 then 1 else 0 end
  from (
    select f.doc_id, k.start as pos, f.clusters, f.unresolved, k.name, k.given, k.family, k.n,
      list_filter(range(1, len(f.clusters) + 1), lambda i: f.clusters[i].key = lower(k.name)
        or (coalesce(f.clusters[i].family = k.family, false) and (f.clusters[i].given is null or k.given is null or f.clusters[i].given = k.given))) as hits
    from fold f join k on k.doc_id = f.doc_id and k.start = f.pos + 1
  )
), last as (
  select doc_id, arg_max(clusters, pos) as clusters, arg_max(unresolved, pos) as unresolved from fold group by 1
)
select doc_id, cluster, x.name as name, array_to_string(x.starts, ',') as starts, unresolved
from (select doc_id, unresolved, unnest(clusters) as x, cast(unnest(range(len(clusters))) as integer) as cluster from last)
union all select doc_id, null, null, null, unresolved from last where len(clusters) = 0
"""


def _heads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({_HEADS})"))).alias("at", "w"))
    first, second = F.split_part("w", F.lit(" "), F.lit(1)), F.split_part("w", F.lit(" "), F.lit(2))
    return docs.select("doc_id", (F.col("at") + 1).alias("start"), first.alias("first"), F.concat(F.upper(F.substring(second, 1, 1)), F.expr("substring(split_part(w, ' ', 2), 2)")).alias("second"))


@query(_PEOPLE)
def people_reconciled(spark, sf_dir):
    """People of each whole document: surnames join the one fuller name before them, or stay unresolved."""
    names = _heads(spark, sf_dir).withColumn("name", F.when(F.col("start") % 3 == 0, F.col("second")).otherwise(F.concat_ws(" ", "first", "second")))
    found = r.people(names, "doc_id", "name", "start")
    return found.select("doc_id", "cluster", "name", F.expr("array_join(transform(starts, x -> cast(x as string)), ',')").alias("starts"), "unresolved")


# every second head is the initials of a name of the same two words and a third
_ORGANIZATIONS = f"""
with recursive h as (
  select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as start from (select doc_id, regexp_extract_all(text, '{_HEADS}') as w from documents)
), k as (
  select doc_id, start, start % 2 = 0 as short, case when start % 2 = 0 then upper(left(w, 1) || left(split_part(w, ' ', 2), 1)) else split_part(w, ' ', 1) || ' ' || upper(left(split_part(w, ' ', 2), 1)) || substr(split_part(w, ' ', 2), 2) end as name,
    lower(left(w, 1) || left(split_part(w, ' ', 2), 1)) as initials, list_filter([lower(split_part(w, ' ', 1)), split_part(w, ' ', 2)], lambda x: x not in ('a', 'an', 'and', 'at', 'by', 'for', 'in', 'of', 'on', 'the', 'to')) as counted from h
), c as (
  select doc_id, start, name, short, lower(name) as norm, case when not short and len(counted) >= 2 then initials end as acronym from k
), fold as (
  select doc_id, cast(0 as bigint) as pos, cast([] as struct(name varchar, norm varchar, acronym varchar, short boolean, starts bigint[])[]) as clusters, 0 as unresolved from (select distinct doc_id from c)
  union all
  select doc_id, pos, case
      when len(hits) = 1 then list_transform(clusters, lambda x, i: case when i = hits[1] then
        struct_pack(name := case when better then name else x.name end, norm := case when better then norm else x.norm end, acronym := case when better then acronym else x.acronym end, short := case when better then short else x.short end, starts := list_append(x.starts, pos)) else x end)
      when short then clusters
      else list_append(clusters, struct_pack(name := name, norm := norm, acronym := acronym, short := short, starts := [pos])) end,
    unresolved + case when len(hits) <> 1 and short then 1 else 0 end
  from (
    select *, len(hits) = 1 and ((clusters[hits[1]].short and not short) or (clusters[hits[1]].short = short and strlen(norm) > strlen(clusters[hits[1]].norm))) as better from (
      select f.doc_id, c.start as pos, f.clusters, f.unresolved, c.name, c.norm, c.acronym, c.short,
        list_filter(range(1, len(f.clusters) + 1), lambda i: f.clusters[i].norm = c.norm or coalesce(f.clusters[i].acronym = c.norm, false) or coalesce(c.acronym = f.clusters[i].norm, false)) as hits
      from fold f join c on c.doc_id = f.doc_id and c.start = f.pos + 1
    )
  )
), last as (
  select doc_id, arg_max(clusters, pos) as clusters, arg_max(unresolved, pos) as unresolved from fold group by 1
)
select doc_id, cluster, x.name as name, array_to_string(x.starts, ',') as starts, unresolved
from (select doc_id, unresolved, unnest(clusters) as x, cast(unnest(range(len(clusters))) as integer) as cluster from last)
union all select doc_id, null, null, null, unresolved from last where len(clusters) = 0
"""


@query(_ORGANIZATIONS)
def organizations_reconciled(spark, sf_dir):
    """Organizations of each whole document: initials join the one name they stand for, or stay unresolved."""
    initials = F.upper(F.concat(F.substring("first", 1, 1), F.substring("second", 1, 1)))
    names = _heads(spark, sf_dir).withColumn("name", F.when(F.col("start") % 2 == 0, initials).otherwise(F.concat_ws(" ", "first", "second")))
    found = r.organizations(names, "doc_id", "name", "start")
    return found.select("doc_id", "cluster", "name", F.expr("array_join(transform(starts, x -> cast(x as string)), ',')").alias("starts"), "unresolved")


@query(f"with h as (select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as start from (select doc_id, regexp_extract_all(text, '{_HEADS}') as w from documents)) select doc_id, arg_min(w, start) as name, count(*) as seen from h group by doc_id, lower(left(w, 4))")
def fingerprints_reconciled(spark, sf_dir):
    """Places of each whole document: one for each fingerprint, here the first four letters, as it is named first."""
    names = _heads(spark, sf_dir).withColumn("name", F.concat_ws(" ", "first", F.lower("second")))
    return r.by_fingerprint(names, "doc_id", F.lower(F.substring("name", 1, 4)), "start", ["name"])
