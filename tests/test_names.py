import hashlib
import hmac

from pyspark.sql import functions as F

from tarnwick.functions import places, text, udfs
from tarnwick.operators import connections as k
from tarnwick.operators import duplicates as d
from tarnwick.operators import runs


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(n) for n, v in values.items())).select(column.alias("x")).first().x


def test_places(spark):
    assert one(spark, places.loose_key("a"), a="The Second Ward, 3rd Precinct") == "the 2 ward 3 precinct"
    assert one(spark, places.covered("a", "b"), a="Old State House, Springfield, IL", b="State House Springfield Illinois")
    assert not one(spark, places.covered("a", "b"), a="State House", b="State House Springfield Illinois")
    assert one(spark, places.opposed("a", "b"), a="North Main", b="Main South") and not one(spark, places.opposed("a", "b"), a="North Main", b="Main North")
    assert not one(spark, places.same_district("a", "b"), a="Ward 3", b="3rd ward".replace("3rd", "4th")) and one(spark, places.same_district("a", "b"), a="Ward 3", b="Precinct 4")
    assert tuple(one(spark, places.jurisdiction("a"), a="1 Main St, Boston, MA 02108, USA")) == ("boston", "massachusetts", "us")
    assert tuple(one(spark, places.jurisdiction("a"), a="Paris")) == (None, None, None)
    assert one(spark, places.display("a"), a="museum OF the USA") == "Museum of the USA"


def test_udfs(spark):
    assert one(spark, udfs.sequence_ratio("a", "b"), a="abcd", b="bcde") == 0.75 and one(spark, udfs.sequence_ratio("a", "b"), a="x", b="x") == 1.0
    assert one(spark, udfs.unmarked("a"), a="Ǻé①") == "Ae1"


def test_signature(spark):
    for key in ("s", "schlüssel", "k" * 64, "long " * 20):
        assert one(spark, text.signature("a", "b", "c"), a=key, b="1", c='{"ä": 1}') == hmac.new(key.encode(), '1.{"ä": 1}'.encode(), hashlib.sha256).hexdigest()
    assert one(spark, text.signature("a", "b", "c"), a="s", b="1", c=None) is None


def test_organizations_and_dismissals(spark):
    rows = spark.createDataFrame([(1, "River City Museum"), (2, "The Museum, River City"), (3, "river city MUSEUM"), (4, "River School 12"), (5, "River School 13"), (6, "Bank")], "id long, label string")
    # 1 stands for 3, whose label is equal
    assert sorted((r.a, r.b) for r in d.organization_pairs(rows).collect()) == [(1, 2), (1, 3)]
    dismissed = spark.createDataFrame([("1|2",), ("2|3",)], "pair_key string")
    pairs = d.organization_pairs(rows, dismissed)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(1, 2), (1, 3), (2, 3)]
    assert [(r.cluster, r.members) for r in d.clusters(pairs, dismissed).collect()] == [(1, "1,3")]
    # a copy that editors keep apart from its representative stays tied to what they didn't dismiss
    dismissed = spark.createDataFrame([("1|3",)], "pair_key string")
    assert [(r.cluster, r.members) for r in d.clusters(d.organization_pairs(rows, dismissed), dismissed).collect()] == [(1, "1,2,3")]


def test_no_key_is_too_frequent(spark):
    """400 people of one family name, more than any block cap: pairs are those of brute force."""
    given = ["Annemarie", "Annemaria", "Bartholomew", "Christopher", "Kristopher", "Maximilian", "Maximiliane", "Konstantin"]
    names = [f"{g} {chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i % 7)}{chr(97 + i % 5)}quist Featherstonehaugh" for i in range(50) for g in given]
    rows = spark.createDataFrame(list(enumerate(names)) + [(900, names[3].upper()), (901, None)], "id long, label string")
    got = {(r.a, r.b) for r in d.person_pairs(rows).collect()}

    def grams(x):
        return {f"  {w} "[i : i + 3] for w in x.lower().split() for i in range(len(w) + 1)}

    def score(x, y):
        sets = [(grams(x), grams(y)), (set(x.lower().split()), set(y.lower().split()))]
        return max(len(a & b) / len(a | b) for a, b in sets)

    want = {(i, j) for j in range(400) for i in range(j) if names[i][0] == names[j][0] and score(names[i], names[j]) >= d.PERSON_SCORE}
    assert len(want) > 10 and got == want | {(3, 900)}


def test_cluster_order(spark):
    found = spark.createDataFrame([(1, 2), (5, 3), (9, 2), (20, 2)], "cluster long, size long")
    members = spark.createDataFrame([(1, 1, "Zoo"), (1, 2, "zoo "), (5, 5, "B"), (5, 6, "B c"), (5, 7, None), (9, 9, "Alm"), (9, 10, "ALM"), (20, 20, "a"), (20, 21, "c")], "cluster long, id long, label string")
    got = d.ordered(found, members).orderBy("ordinal").collect()
    assert [(r.cluster, r.exact, r.label) for r in got] == [(9, True, "alm"), (1, True, "zoo"), (5, False, "b"), (20, False, "a")]


def test_latest_check(spark):
    rows = spark.createDataFrame([(1, "s", "c", 5, "done"), (2, "s", "c", 7, "failed"), (3, "s", "c", 7, "done"), (4, "t", "c", 1, "failed")], "id long, scope string, check string, created_at long, status string")
    assert sorted((r.scope, r.id) for r in runs.latest_check(rows).collect()) == [("s", 3), ("t", 4)]
    assert [(r.scope, r.id) for r in runs.latest_check(rows, "failed").orderBy("scope").collect()] == [("s", 2), ("t", 4)]


def test_connections(spark):
    rows = spark.createDataFrame([(1, "p", 1, "o", 2, "works", 0.95, "q"), (1, "p", 1, "o", 2, "works", 0.99, "r"), (1, "p", 1, "o", 3, "works", 0.5, "q"), (1, "p", 1, "o", 4, "works", 0.95, " "), (1, "p", 1, "p", 1, "works", 0.95, "q"), (1, "p", 1, "o", 5, "eats", 0.95, "q")], "article long, from_type string, from_id long, to_type string, to_id long, nature string, confidence double, quote string")
    rules = spark.createDataFrame([("p", "o", "works"), ("p", "p", "works")], "from_type string, to_type string, nature string")
    assert [(r.to_id, r.quote) for r in k.valid(rows, rules).collect()] == [(2, "r")]
    edges = spark.createDataFrame([("p", 1, "o", 2, "leads"), ("p", 1, "o", 2, "works"), ("p", 1, "o", 3, "works")], "from_type string, from_id long, to_type string, to_id long, nature string")
    weaker = spark.createDataFrame([("works", "leads")], "nature string, by string")
    assert sorted((r.to_id, r.nature) for r in k.subsumed(edges, weaker).collect()) == [(2, "leads"), (3, "works")]


def test_slugs(spark):
    rows = spark.createDataFrame([(n, "A b!") for n in range(10)] + [(99, "??")], "id long, label string")
    got = {r.id: r.slug for r in runs.slugs(rows, "id", "label").collect()}
    assert got[0] == "a-b" and got[7] == "a-b-8" and got[9] == "a-b-10" and got[99] == "item" and len(set(got.values())) == 11
    taken = spark.createDataFrame([("a-b",), ("a-b-3",)], "slug string")
    assert [r.slug for r in runs.slugs(rows.filter("id < 3"), "id", "label", taken).orderBy("id").collect()] == ["a-b-2", "a-b-4", "a-b-5"]
    rows = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A 2"), (4, "Route 66")], "id long, label string")
    taken = spark.createDataFrame([("route-66",)], "slug string")
    assert {r.id: r.slug for r in runs.slugs(rows, "id", "label", taken).collect()} == {1: "a", 2: "a-3", 3: "a-2", 4: "route-66-2"}


def test_slugs_of_a_large_base(spark):
    """100,000 rows of one base beside taken numbers: all different, none taken, the smallest free ones."""
    n = 100_000
    rows = spark.range(n).select("id", F.lit("Main St").alias("label"))
    numbers = [1, 2, 5, 6, 7, 500, n, n + 3, 10**12]
    taken = spark.createDataFrame([("main-st" if k == 1 else f"main-st-{k}",) for k in numbers] + [("other",), ("main-st-x",)], "slug string")
    got = runs.slugs(rows, "id", "label", taken).toPandas().set_index("id").sort_index().slug.tolist()
    free = [k for k in range(1, n + 20) if k not in numbers][:n]
    assert got == [f"main-st-{k}" for k in free]
