"""The small languages of search parameters: web-search text and attribute clauses, as predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERM = re.compile(r'(-?)"([^"]*)"|(-?)(\S+)')


def web_search(query: str, text: Column) -> Column:
    """Words all have to occur; "phrases" in order; OR joins neighbours; a minus excludes. Words are ASCII letters and digits, without case."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    groups: list[list[Column]] = []
    join = False
    for minus1, phrase, minus2, word in _TERM.findall(query):
        if word == "OR":
            join = bool(groups)
            continue
        words = re.findall("[a-z0-9]+", (phrase or word).lower())
        if not words:
            continue
        found = F.contains(padded, F.lit(f" {' '.join(words)} "))
        term = ~found if minus1 or minus2 else found
        if join:
            groups[-1].append(term)
        else:
            groups.append([term])
        join = False
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, g) for g in groups), F.lit(True))


def term_rank(query: str, text: Column) -> Column:
    """How often the query's plain words occur, over the logarithm of the text's length: the order of relevance."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", "  "), F.lit(" "))
    words = [w for m1, p, m2, x in _TERM.findall(query) if not (m1 or m2) and x != "OR" for w in re.findall("[a-z0-9]+", (p or x).lower())]
    hits = reduce(lambda a, b: a + b, ((F.length(padded) - F.length(F.replace(padded, F.lit(f" {w} ")))) / (len(w) + 2) for w in words), F.lit(0.0))
    return hits / (1 + F.log(F.lit(1.0) + F.length(text)))


#: The most values of one attribute clause.
VALUES = 50


def clause(spec: str) -> tuple[bool, str, str, list]:
    """(negated, key, operator, values) of `key`, `key:value` or `key:op:value|value`, with ! in front for the opposite.

    Values are booleans, then numbers, then text. Only eq and ieq take several, and `VALUES` at most.
    """
    negated, spec = spec.startswith("!"), spec.lstrip("!")
    key, *rest = spec.split(":", 2)
    if not rest:
        return negated, key, "exists", []
    operators = ("exists", "eq", "neq", "ieq", "ineq", "lt", "lte", "gt", "gte")
    op, values = (rest[0], rest[1]) if len(rest) == 2 and rest[0] in operators else ("eq", ":".join(rest))
    found = [_literal(v) for v in values.split("|")]
    if len(found) > VALUES:
        raise ValueError(f"{len(found)} values in a clause, {VALUES} at most")
    if len(found) > 1 and op not in ("eq", "ieq"):
        raise ValueError(f"{op} takes one value")
    return negated, key, op, found


def meta_clause(spec: str) -> tuple[bool, str, list[str]]:
    """(negated, type, categories) of `type` or `type:category|category`, with ! in front for the opposite.

    Blanks around each part go, repeated categories count once. An empty part and more than `VALUES` categories are errors.
    """
    spec = spec.strip()
    negated = spec.startswith("!")
    kind, colon, every = spec[negated:].partition(":")
    categories = list(dict.fromkeys(c.strip() for c in every.split("|"))) if colon else []
    if not kind.strip() or "" in categories:
        raise ValueError(f"an empty part in the clause {spec!r}")
    if len(categories) > VALUES:
        raise ValueError(f"{len(categories)} categories in a clause, {VALUES} at most")
    return negated, kind.strip(), categories


def _literal(text: str) -> bool | float | str:
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    try:
        return float(text)
    except ValueError:
        return text


def matches(op: str, values: list, *, text: Column, number: Column, boolean: Column) -> Column:
    """The clause's comparison on a typed key-value row."""
    if op == "exists":
        return F.lit(True)

    def one(v) -> Column:
        column = boolean if isinstance(v, bool) else number if isinstance(v, float) else text
        a, b = (F.lower(column), F.lit(v.lower())) if op in ("ieq", "ineq") and isinstance(v, str) else (column, F.lit(v))
        return {"eq": a == b, "ieq": a == b, "neq": a != b, "ineq": a != b, "lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[op]

    return reduce(lambda a, b: a | b, map(one, values))
