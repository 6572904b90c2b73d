import itertools

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import persons as names
from tarnwick.functions import search
from tarnwick.operators import articles, persons


@pytest.mark.parametrize(
    "name, given, family",
    [
        ("Juan de la Cruz", "juan", "cruz"), ("Robert J. Miller Jr.", "robert", "miller"), ("Ludwig van", "ludwig", "van"), ("Maria Vega de", "maria", "vega"),
        ("Prince", "prince", "prince"), ("J. R.", None, None), ("José  Núñez", "jose", "nunez"), ("Jr.", "jr", "jr"), ("", None, None), (None, None, None), (" . ", None, None),
    ],
)
def test_parts(spark, name, given, family):
    r = spark.createDataFrame([(name,)], "n string").select(names.parts("n").alias("p")).first().p
    assert (r.given, r.family) == (given, family)


@pytest.mark.parametrize(
    "a, b, score",
    [
        ("Tom Hill", "Thomas Hill", 105), ("Bob Stone", "Robert Stone", 105), ("Rob Stone", "Bill Stone", 65), ("Tom Hill", "tom  hill", 205), ("Liz Hill", "Elizabeth Moor", 25),
        ("Dan Hill", "Dane Hill", 105), ("Al Hill", "Alan Hill", 105), ("Jo Hill", "Joan Q. Hill", 105), ("Ann Hill", "Moor", 0), ("Tom Hill", "Hill", 105), ("Tom Hill", None, 0), ("", "Tom", 0),
    ],
)
def test_overlap(spark, a, b, score):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(names.overlap("a", "b").alias("s")).first().s == score


def test_pairs_meet_all_compatible_names_and_no_false_friends(spark):
    given = ["Tom", "Thomas", "Tommy", "Bob", "Rob", "Robert", "Bobbie", "Bill", "Will", "Willa", "Liam", "Lia", "Kit", "Chris", "Christine", "Kate", "Kathleen", "Al", "Alex", "Alexandra", "Dan", "Dana"]
    rows = [(i, f"{g} {f}") for i, (g, f) in enumerate(itertools.product(given, ("Hill", "Moor")))] + [(99, None), (98, ""), (97, "TOM HILL"), (96, "Tom Q. Hill")]
    got = {(r.family, r.a, r.b) for r in persons.pairs(spark.createDataFrame(rows, "id long, label string"), "label").collect()}
    of = {n: i for i, c in enumerate(names.GIVEN_CLASSES) for n in c}
    low = sorted(g.lower() for g in given)
    fits = lambda a, b: (a in of and of.get(a) == of.get(b)) or a.startswith(b) or b.startswith(a)
    want = {(f, a, b) for f in ("hill", "moor") for a, b in itertools.combinations(low, 2) if fits(a, b)}
    assert got == want
    assert ("hill", "bill", "liam") in got and ("hill", "bill", "bob") not in got and ("hill", "kate", "kathleen") not in got


def test_recall_by_nickname(spark):
    people = spark.createDataFrame([(1, "Bob Stone"), (2, "Bob Stone"), (3, None)], "id long, label string")
    catalog = spark.createDataFrame([(10, "Robert Stone"), (11, "Bob Stone"), (12, "Bill Stone"), (13, "Robert Hill"), (14, None)], "c long, name string")
    got = {(r.label, r.canonical, r.score) for r in persons.recall(people, "label", catalog, "c", "name").collect()}
    assert got == {("Bob Stone", 10, 105), ("Bob Stone", 11, 205)}


def test_meta_clauses_as_text(spark):
    assert search.meta_clause(" ! kind : a | b|a ") == (True, "kind", ["a", "b"])
    assert search.meta_clause("kind") == (False, "kind", [])
    assert search.meta_clause("kind:a:b") == (False, "kind", ["a:b"])
    for bad in ("", "!", " ! ", ":a", "kind:", "kind:a||b", "kind:" + "|".join(map(str, range(51)))):
        with pytest.raises(ValueError):
            search.meta_clause(bad)
    df = spark.range(3)
    meta = df.select("id", F.lit("kind").alias("meta_type"), F.col("id").cast("string").alias("category"))
    assert [r.id for r in articles.meta_clauses(df, meta, "id", ["kind:0|1", "!kind:1"]).collect()] == [0]
    with pytest.raises(ValueError):
        articles.meta_clauses(df, meta, "id", ["kind"] * 26)
