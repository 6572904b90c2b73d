"""Filters, searches and pages over articles, and typed key-value predicates on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.functions import search, text


def date_range(df: DataFrame, column: str, first=None, last=None) -> DataFrame:
    """Rows from `first` to `last`, both included; rows without a date drop as soon as a bound is given."""
    if first is not None:
        df = df.filter(F.col(column) >= F.lit(first))
    return df if last is None else df.filter(F.col(column) <= F.lit(last))


#: The most attribute clauses of one request.
CLAUSES = 25


def of_natures(df: DataFrame, natures: list[str] | None, column: str = "nature") -> DataFrame:
    """Rows of any of the natures; blanks and doubles don't count, and without any left all rows stay."""
    wanted = list(dict.fromkeys(n.strip() for n in natures or [] if n and n.strip()))
    return df.filter(F.col(column).isin(wanted)) if wanted else df


def canonical_presence(df: DataFrame, present: bool | None, column: str = "canonical_id") -> DataFrame:
    """Rows with a canonical, without one, or all where `present` is None."""
    if present is None:
        return df
    return df.filter(F.col(column).isNotNull() if present else F.col(column).isNull())


def equal_without_case(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.filter(F.lower(column) == value.strip().lower())


def having(df: DataFrame, others: DataFrame, key: str, *, negate: bool = False) -> DataFrame:
    """Rows whose key occurs (or, negated, doesn't) in `others`."""
    return df.join(others.select(key), key, "left_anti" if negate else "left_semi")


def meta_clauses(df: DataFrame, meta: DataFrame, key: str, clauses: list[str | tuple[bool, str, list[str]]]) -> DataFrame:
    """(negated, type, categories) clauses or their text (see `functions.search.meta_clause`), all to hold; each one's categories are
    alternatives. More than `CLAUSES` are an error.

    However many there are, the key-value table is read and shuffled once: each clause is a flag of one aggregate.
    """
    if len(clauses) > CLAUSES:
        raise ValueError(f"{len(clauses)} metadata clauses, {CLAUSES} at most")
    if not clauses:
        return df
    clauses = [search.meta_clause(c) if isinstance(c, str) else c for c in clauses]
    flags = []
    for i, (_, kind, categories) in enumerate(clauses):
        hit = F.col("meta_type") == kind
        flags.append(F.max((hit & F.col("category").isin(categories)) if categories else hit).alias(f"c{i}"))
    found = meta.filter(F.col("meta_type").isin(sorted({k for _, k, _ in clauses}))).groupBy(key).agg(*flags)
    holds = reduce(lambda a, b: a & b, (~F.coalesce(f"c{i}", F.lit(False)) if negated else F.coalesce(f"c{i}", F.lit(False)) for i, (negated, *_) in enumerate(clauses)))
    return df.join(found, key, "left").filter(holds).select(*df.columns)


def attribute_clauses(df: DataFrame, attributes: DataFrame, key: str, specs: list[str]) -> DataFrame:
    """Rows of which each clause (see `functions.search.clause`) finds an attribute row, or with ! finds none.

    `attributes` has the key, name, value_text, value_number and value_boolean. More than `CLAUSES` are an error: a
    clause that were left out would widen the result.
    """
    if len(specs) > CLAUSES:
        raise ValueError(f"{len(specs)} attribute clauses, {CLAUSES} at most")
    for spec in specs:
        negated, name, op, values = search.clause(spec)
        hit = search.matches(op, values, text=F.col("value_text"), number=F.col("value_number"), boolean=F.col("value_boolean"))
        df = having(df, attributes.filter((F.col("name") == name) & hit), key, negate=negated)
    return df


def keyword(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Web-search text over the joined columns."""
    return df.filter(search.web_search(query, F.concat_ws(" ", *columns)))


def contains_any(df: DataFrame, part: str, *columns: str) -> DataFrame:
    """A substring without case in any of the columns; % and _ mean themselves."""
    return df.filter(reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(part.lower())) for c in columns)))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in total order; Spark keeps only limit + offset rows of each task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page whose rows carry the number of all rows, counted apart so that no window holds the table."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, limit, offset).join(F.broadcast(total), how="cross")


def per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def resolved(params: dict) -> dict:
    """Parameters of a list request with what they imply: a section is a category of the type topic, and the order is
    relevance where there is a query, else the date; descending unless said."""
    q, section = (params.get("q") or "").strip(), (params.get("section") or "").strip()
    out = params | {"sort": params.get("sort") or ("relevance" if q else "pub_date"), "direction": params.get("direction") or "desc", "section": None}
    return out | {"meta_type": "topic", "meta_category": section} if section else out


def listed(articles: DataFrame, meta: DataFrame, key: str, date: str, params: dict, *columns: str) -> DataFrame:
    """Articles of a request: metadata and query as filters, then the order and one page of `limit` rows (20).

    Articles without a date come last when descending and first when ascending; ties go by the key, in the same direction.
    """
    p = resolved(params)
    q, down = (p.get("q") or "").strip(), p["direction"] == "desc"
    if p.get("meta_type"):
        articles = meta_clauses(articles, meta, key, [(False, p["meta_type"], [p["meta_category"]] if p.get("meta_category") else [])])
    if q:
        articles = keyword(articles, q, *columns)
    by = search.term_rank(q, F.concat_ws(" ", *columns)) if p["sort"] == "relevance" and q else F.col(date)
    order = [F.desc_nulls_last("__by"), F.desc(key)] if down else [F.asc_nulls_first("__by"), F.asc(key)]
    return page(articles.withColumn("__by", by), order, p.get("limit", 20), p.get("offset", 0)).drop("__by")


def canonical_list(canonicals: DataFrame, aliases: DataFrame, mentions: DataFrame, *, part: str = "", kind: str | None = None, natures: list[str] | None = None, projects: list[int] | None = None, least: int = 0) -> DataFrame:
    """Canonicals (id, label, kind) whose label or any alias (canonical, alias) holds `part`, of one kind, mentioned in one of the
    natures, and at least `least` times, both counted over `projects` alone where given (mentions: canonical, nature, project)."""
    if kind:
        canonicals = canonicals.filter(F.col("kind") == kind)
    if part.strip():
        hit = lambda c: F.contains(F.lower(c), F.lit(part.strip().lower()))
        by_alias = aliases.filter(hit("alias")).select(F.col("canonical").alias("id")).distinct().withColumn("__hit", F.lit(True))
        canonicals = canonicals.join(by_alias, "id", "left").filter(hit("label") | F.col("__hit")).drop("__hit")
    counted = mentions if projects is None else mentions.filter(F.col("project").isin(projects))
    counted = counted.withColumnRenamed("canonical", "id")
    if natures:
        canonicals = canonicals.join(of_natures(counted, natures).select("id"), "id", "left_semi")
    if least > 0:
        canonicals = canonicals.join(counted.groupBy("id").agg(F.count("*").alias("__n")).filter(F.col("__n") >= least), "id", "left_semi")
    return canonicals


def first_seen(items: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, value, place): each value of a group once, in the order in which it first came; nulls don't count."""
    first = items.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("__first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__first", value))).drop("__first")


def keyword_rank(label: str, query: str) -> list[Column]:
    """Order of name matches: equal, then begins with, then the rest; shorter first, then by name."""
    norm, q = text.normalize_text(label), query.strip().lower()
    return [F.when(norm == q, 0).when(F.startswith(norm, F.lit(q)), 1).otherwise(2), F.length(label), F.lower(label)]


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """(facet, value): the distinct values that aren't null, of all columns in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.facet", "p.value").filter("value is not null").distinct()
