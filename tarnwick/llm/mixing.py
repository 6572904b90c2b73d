"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Each source's share of all tokens is raised to one exponent between 0 (all sources alike)
and 1 (as they are) and normalised. The exponent is bisected: to the smallest for which no
source is repeated more than `max_repetition` times within the budget, or to the largest
whose weights still have the target entropy.

A source's weight times the budget is its number of tokens. Its documents lie in blocks of
about `BLOCK_TOKENS`, blocks in super-blocks, and every epoch has its own permutation of
both, drawn by hash. Whole epochs take every document once more. In the last one, which
takes only part, the budget is descended: super-blocks in permuted order until it would be
exceeded, then the blocks of that one super-block, then the documents of that one block.
So a running sum never spans more than one level's few rows, even of a source with a third
of all rows.

DataFrame functions only. What is joined to documents has one row for each source; Spark
broadcasts it while it is small and otherwise splits the hot source's join.

Defined cases: tokens are words between ASCII white space; a null or empty text has none and
is never copied more than its source's whole epochs; a null source is the source ''; sources
without tokens get no weight and their rows are not in the result; equal rows tie and are taken or left together; a limit that even
the exponent 1 exceeds gives exponent 1; an empty table gives an empty mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.session import materialise, table

BLOCK_TOKENS = 1 << 20
FANOUT = 1024
STEPS = 40
#: The query's and the pipeline's limit: a source is repeated at most so many times.
MAX_REPETITION = 1.25


def n_tokens(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(*parts: Column | str) -> Column:
    """A hash of the joined parts as hex, followed by the last part, so that no two differ only by chance."""
    text = F.concat_ws("/", *(F.coalesce(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string"), F.lit("")) for p in parts))
    return F.concat(F.md5(text), F.lit("/"), F.coalesce((parts[-1] if isinstance(parts[-1], Column) else F.col(parts[-1])).cast("string"), F.lit("")))


def _number(hexed: Column) -> Column:
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def _meets(totals: DataFrame, exponents: list[float], budget: float, max_repetition: float | None, entropy: float | None) -> list[bool]:
    """Whether the target holds, for each exponent; one row of sums comes back, however many sources there are."""
    t = F.col("tokens").cast("double")
    sums = []
    for i, a in enumerate(exponents):
        sums += [F.sum(F.pow(t, F.lit(a))).alias(f"s{i}")]
        sums += [F.max(F.pow(t, F.lit(a - 1))).alias(f"m{i}")] if entropy is None else [F.sum(F.pow(t, F.lit(a)) * F.log(t) * a).alias(f"m{i}")]
    row = totals.agg(*sums).first()
    if entropy is None:
        return [row[f"m{i}"] * budget / row[f"s{i}"] <= max_repetition for i in range(len(exponents))]
    # the entropy of normalised powers: log(sum) less the mean log
    return [math.log(row[f"s{i}"]) - row[f"m{i}"] / row[f"s{i}"] >= entropy for i in range(len(exponents))]


def exponent(totals: DataFrame, budget: float, *, max_repetition: float | None = None, entropy: float | None = None) -> float:
    """The bisected exponent over (source, tokens) rows with tokens. Five halvings go into each pass over the sources."""
    if (max_repetition is None) == (entropy is None):
        raise ValueError("give max_repetition or entropy")
    low, width, depth = 0.0, 1.0, 5
    # repetition falls and entropy falls with the exponent: the one is met from some exponent on, the other up to one
    if _meets(totals, [0.0 if entropy is None else 1.0], budget, max_repetition, entropy)[0]:
        return 0.0 if entropy is None else 1.0
    for _ in range(STEPS // depth):
        width /= 2**depth
        inner = [low + k * width for k in range(1, 2**depth)]
        met = _meets(totals, inner, budget, max_repetition, entropy)
        low += width * sum(not x if entropy is None else x for x in met)
    return low + width if entropy is None else low


def _cut(rows: DataFrame, key: str) -> DataFrame:
    """For each source the first key, in permuted order, that would exceed what is left, and what is left before it."""
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy(key))
    over = rows.withColumn("run", run).filter(F.col("run") > F.col("left"))
    return over.groupBy("source").agg(F.min(key).alias("cut"), F.min(F.struct(key, (F.col("left") - F.col("run") + F.col("tokens")).alias("left"))).alias("at")).select("source", "cut", F.col("at.left").alias("left"))


def plan(rows: DataFrame, *, budget: int | None = None, max_repetition: float | None = None, entropy: float | None = None, seed: int = 0) -> DataFrame:
    """(source, tokens, weight, quota, epochs, last, and the three cuts of the last epoch) from (doc_id, source, tokens) rows."""
    totals = materialise(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "totals")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    a = exponent(totals, float(budget), max_repetition=max_repetition, entropy=entropy) if total else 1.0
    power = F.pow(F.col("tokens").cast("double"), F.lit(a))
    scale = totals.agg(F.sum(power)).first()[0] or 1.0
    sources = totals.withColumn("weight", power / F.lit(scale)).withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget))).cast("long"))
    sources = sources.withColumn("epochs", F.expr("quota div tokens")).withColumn("last", F.expr("quota % tokens"))
    placed = place(rows, sources, seed)
    supers = placed.groupBy("source", "super_key", "left").agg(F.sum("tokens").alias("tokens"))
    first = materialise(_cut(supers, "super_key").select("source", F.col("cut").alias("super_cut"), F.col("left").alias("left1")), "cut")
    inside = placed.join(first, "source").filter("super_key = super_cut").withColumn("left", F.col("left1"))
    blocks = inside.groupBy("source", "block_key", "left").agg(F.sum("tokens").alias("tokens"))
    second = materialise(_cut(blocks, "block_key").select("source", F.col("cut").alias("block_cut"), F.col("left").alias("left2")), "cut")
    inside = inside.join(second, "source").filter("block_key = block_cut").withColumn("left", F.col("left2"))
    third = _cut(inside.groupBy("source", "doc_key", "left").agg(F.sum("tokens").alias("tokens")), "doc_key").select("source", F.col("cut").alias("doc_cut"))
    cuts = first.select("source", "super_cut").join(second.select("source", "block_cut"), "source", "left").join(third, "source", "left")
    return materialise(sources.join(cuts, "source", "left"), "mixture")


def place(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Rows with their blocks and, for the last epoch of their source, the permuted keys."""
    n_blocks = F.greatest(F.lit(1), F.expr(f"(s_tokens + {BLOCK_TOKENS - 1}) div {BLOCK_TOKENS}"))
    s = sources.select(F.col("source").alias("s_source"), F.col("tokens").alias("s_tokens"), F.col("last").alias("left"), F.col("epochs").alias("s_epochs"))
    out = rows.join(s, F.col("source") == F.col("s_source")).drop("s_source")
    out = out.withColumn("block", F.pmod(_number(F.md5(F.concat(F.lit("block/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))), n_blocks))
    out = out.withColumn("super", F.expr(f"block div {FANOUT}"))
    epoch = F.col("s_epochs")
    return (
        out.withColumn("super_key", _key(F.lit(seed), epoch, F.lit("super"), F.col("super")))
        .withColumn("block_key", _key(F.lit(seed), epoch, F.lit("block"), F.col("block")))
        .withColumn("doc_key", _key(F.lit(seed), epoch, F.lit("doc"), F.col("doc_id")))
    )


def copies(rows: DataFrame, sources: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, block, weight, copies): how often the mixture takes each row, zero included."""
    placed = place(rows, sources, seed).drop("s_tokens", "s_epochs", "left")
    s = sources.select(F.col("source").alias("s_source"), "weight", "epochs", "super_cut", "block_cut", "doc_cut")
    out = placed.join(s, F.col("source") == F.col("s_source")).drop("s_source")
    # in the last epoch: before the cut at some level, and at the cut on those above; no cut means no token is left to take
    taken = F.col("super_key") < F.col("super_cut")
    taken = taken | ((F.col("super_key") == F.col("super_cut")) & (F.col("block_key") < F.col("block_cut")))
    taken = taken | ((F.col("super_key") == F.col("super_cut")) & (F.col("block_key") == F.col("block_cut")) & (F.col("doc_key") < F.col("doc_cut")))
    return out.select("doc_id", "source", "tokens", "block", "weight", (F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("long")).alias("copies"))


def _narrow(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), n_tokens(text_col).alias("tokens"))


def mixture(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, **target) -> DataFrame:
    """The rows of `docs` that the mixture takes, with `mix_copies` and `mix_weight`; order them by `mix_order` within an epoch.

    Rows are counted where they lie: the plan has one row for each source, and texts are not shuffled
    while Spark can broadcast it.
    """
    rows = materialise(_narrow(docs, id_col, source_col, text_col), "tokens")
    sources = plan(rows, seed=seed, **target)
    mine = ["__source", "__tokens", "mix_copies", "mix_weight", "mix_order"]
    keep = [c for c in docs.columns if c not in mine]
    own = docs.select(*keep, F.struct(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), n_tokens(text_col).alias("tokens"), F.struct(*keep).alias("row")).alias("__mix")).select("__mix.*")
    s = sources.select(F.col("source").alias("m_source"), "weight", "epochs", "super_cut", "block_cut", "doc_cut")
    placed = place(own, sources, seed).join(s, F.col("source") == F.col("m_source"))
    at_super, at_block = F.col("super_key") == F.col("super_cut"), F.col("block_key") == F.col("block_cut")
    taken = (F.col("super_key") < F.col("super_cut")) | (at_super & (F.col("block_key") < F.col("block_cut"))) | (at_super & at_block & (F.col("doc_key") < F.col("doc_cut")))
    n = F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("long")
    order = F.concat_ws("|", "super_key", "block_key", "doc_key")
    return placed.withColumn("n", n).filter("n > 0").select("row.*", F.col("n").alias("mix_copies"), F.col("weight").alias("mix_weight"), order.alias("mix_order"))


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document enters a mixture of as many tokens as there are, no source more than MAX_REPETITION times over."""
    rows = materialise(_narrow(table(spark, sf_dir, "documents"), "doc_id", "source", "text"), "tokens")
    sources = plan(rows, max_repetition=MAX_REPETITION)
    return copies(rows, sources).select("doc_id", "source", F.col("tokens").alias("n_tokens"), F.col("block").cast("long").alias("block"), F.round("weight", 9).alias("weight"), "copies")


#: The same in SQL. DuckDB's regular expressions name the same white space.
OP1_SQL = f"""
with recursive docs as (
  select doc_id, coalesce(source, '') as source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as tokens from documents
), totals as (
  select source, cast(sum(tokens) as bigint) as tokens from docs group by 1 having sum(tokens) > 0
), facts as (
  select list(cast(tokens as double) order by tokens) as ts, cast(sum(tokens) as double) as budget from totals
), bisect as (
  select 0 as i, cast(0 as double) as lo, cast(1 as double) as hi from facts
  union all
  select i + 1,
    case when m * budget / s <= {MAX_REPETITION} then lo else (lo + hi) / 2 end,
    case when m * budget / s <= {MAX_REPETITION} then (lo + hi) / 2 else hi end
  from (
    select i, lo, hi, budget, list_sum(list_transform(ts, lambda t: pow(t, (lo + hi) / 2))) as s, list_max(list_transform(ts, lambda t: pow(t, (lo + hi) / 2 - 1))) as m
    from bisect, facts where i < {STEPS}
  )
), chosen as (
  select case when 1 / list_min(ts) * budget / len(ts) <= {MAX_REPETITION} then 0.0 else hi end as a, budget from bisect, facts where i = {STEPS}
), w as (
  select source, tokens, pow(cast(tokens as double), a) / sum(pow(cast(tokens as double), a)) over () as weight, budget from totals, chosen
), sources as (
  select source, tokens as s_tokens, weight, cast(floor(weight * budget) as bigint) // tokens as epochs, cast(floor(weight * budget) as bigint) % tokens as "left" from w
), b as (
  select d.*, s.* exclude (source),
    ('0x' || substr(md5('block/' || coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint % greatest(1, (s_tokens + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS}) as block
  from docs d join sources s on d.source = s.source
), placed as (
  select *,
    md5('0/' || epochs || '/super/' || (block // {FANOUT})) || '/' || (block // {FANOUT}) as super_key,
    md5('0/' || epochs || '/block/' || block) || '/' || block as block_key,
    md5('0/' || epochs || '/doc/' || coalesce(cast(doc_id as varchar), '')) || '/' || coalesce(cast(doc_id as varchar), '') as doc_key
  from b
), run as (
  select *, sum(tokens) over (partition by source order by super_key, block_key, doc_key) as upto
  from placed
)
select doc_id, source, tokens as n_tokens, cast(block as bigint) as block, round(weight, 9) as weight,
  cast(epochs + case when upto <= "left" then 1 else 0 end as bigint) as copies
from run
"""
