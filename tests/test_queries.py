"""Every registered query beside its SQL on the smallest given tables."""

import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tarnwick import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
queries.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (float, Decimal)):
        return None if x != x else f"{round(float(x), 6) + 0.0:.6f}"
    return str(x)


def rows(df):
    names = sorted(df.columns)
    whole = df.astype(object)
    return names, [tuple(cell(x) for x in r) for r in whole[names].itertuples(index=False)]


def text(x):
    """Numbers alike, whatever their type."""
    try:
        return f"{round(float(x), 6) + 0.0:.6f}" if x is not None else ""
    except ValueError:
        return x


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, sql, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), sql.execute(queries.ORACLE_SQL[name]).df()
    (names, a), (wanted, b) = rows(got), rows(want)
    assert names == wanted
    assert sorted(tuple(map(text, r)) for r in a) == sorted(tuple(map(text, r)) for r in b)


@pytest.mark.parametrize("name", ["dismissed_pairs", "blocking_pairs", "slug_allocation", "slug_allocation_taken", "connected_components", "auto_connections", "geometry_wkt", "organization_duplicates", "affiliation_edges", "stored_check", "signed_deliveries"])
def test_query_gives_what_its_sql_gives_on_more_digits(spark, name):
    """Where ids have one digit each, an order of ids as text is one of numbers."""
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    larger = SF.replace("0.001", "0.01")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{larger}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, larger).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    (names, a), (wanted, b) = rows(got), rows(want)
    assert names == wanted and sorted(tuple(map(text, r)) for r in a) == sorted(tuple(map(text, r)) for r in b)


def test_all_queries_have_sql():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"sequence_ratio"}


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "article"
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
