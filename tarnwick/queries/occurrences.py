"""Evidence found in raw texts whatever its quotes and blanks."""

from pyspark.sql import functions as F

from tarnwick.operators import occurrences as o
from tarnwick.queries import query
from tarnwick.session import table

_PAIR = "([A-Za-z]{4,}) ([A-Za-z]{4,})"


@query(
    f"with d as (select doc_id, text, regexp_extract(text, '{_PAIR}', 1) as a, regexp_extract(text, '{_PAIR}', 2) as b from documents where text is not null),"
    " r as (select doc_id, '“' || a || chr(10) || '  ' || b || '’s' as raw, '\"' || a || ' ' || b || '''s' as needle, replace(text, a || ' ' || b, raw) as whole from d where a <> ''), p as (select *, string_split(whole, raw) as pieces from r),"
    " s as (select *, unnest(range(1, len(pieces))) as i from p), t as (select *, cast(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * length(raw) as integer) as start from s)"
    " select doc_id, needle, start, cast(start + length(raw) as integer) as \"end\", md5(raw) as raw from t"
)
def proven_spans(spark, sf_dir):
    """Each document's first two longer words, quoted in it over two lines and asked for on one."""
    part = lambda k: F.regexp_extract("text", _PAIR, k)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", part(1).alias("a"), part(2).alias("b")).filter("a <> ''")
    written = F.concat(F.lit("“"), "a", F.lit("\n  "), "b", F.lit("’s"))
    texts = docs.select("doc_id", F.replace("text", F.concat_ws(" ", "a", "b"), written).alias("text"))
    evidence = docs.select("doc_id", F.concat(F.lit('"'), "a", F.lit(" "), "b", F.lit("'s")).alias("needle"))
    return o.proven(texts, "doc_id", "text", evidence, "needle").withColumn("raw", F.md5("raw"))
