from pyspark.sql import functions as F

from tarnwick.operators import reconcile as r


def folded(found):
    return [(x.cluster, x.name, x.starts, x.mentions, x.unresolved) for x in found.orderBy("doc", "cluster").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc long, start long, name string")


def test_surnames_join_the_one_fuller_name(spark):
    rows = [(1, 30, "Okafor"), (1, 5, "Ada Okafor"), (1, 60, "ada okafor"), (1, 70, "Ada M. Okafor"), (1, 80, "Ruiz"), (1, None, "Nobody"), (1, 90, " "), (1, 95, None)]
    got = folded(r.people(frame(spark, rows), "doc", "name", "start"))
    assert got == [(0, "Ada M. Okafor", [5, 30, 60, 70], ["Ada Okafor", "Okafor", "ada okafor", "Ada M. Okafor"], 1)]


def test_ambiguous_surnames_stay_unresolved(spark):
    """Two people of one family name: the surname alone names neither; before the second was named it meant the first."""
    rows = [(1, 1, "Ada Okafor"), (1, 2, "Okafor"), (1, 3, "Ben Okafor"), (1, 4, "Okafor"), (1, 5, "A. Okafor"), (2, 1, "Okafor"), (2, 2, "Ada Okafor")]
    got = folded(r.people(frame(spark, rows), "doc", "name", "start"))
    assert got == [(0, "Ada Okafor", [1, 2, 5], ["Ada Okafor", "Okafor", "A. Okafor"], 1), (1, "Ben Okafor", [3], ["Ben Okafor"], 1), (0, "Ada Okafor", [2], ["Ada Okafor"], 1)]


def test_only_surnames(spark):
    assert folded(r.people(frame(spark, [(1, 1, "Ruiz"), (1, 2, "Ruiz")]), "doc", "name", "start")) == [(None, None, None, None, 2)]


def test_marks_and_particles(spark):
    rows = [(1, 1, "José de la Cruz"), (1, 2, "jose de la cruz"), (1, 3, "Peter van Dam"), (1, 4, "Dam")]
    got = folded(r.people(frame(spark, rows), "doc", "name", "start"))
    assert [(x[1], x[2]) for x in got] == [("José de la Cruz", [1, 2]), ("Peter van Dam", [3])] and got[0][4] == 1


def test_chunks_speak_for_what_they_own(spark):
    rows = frame(spark, [(1, 5, "Ada Okafor"), (1, 5, "Ada Okafor"), (1, 50, "Ben Ruiz")]).withColumn("chunk", F.monotonically_increasing_id())
    own = r.owned("start", F.lit(0), F.lit(40))
    assert [x[1] for x in folded(r.people(rows, "doc", "name", "start", own=own))] == ["Ada Okafor"]


def test_organizations_by_initials(spark):
    rows = [(1, 1, "WHO"), (1, 2, "World Health Organization"), (1, 3, "WHO"), (1, 4, "Chicago Public Schools"), (1, 5, "Central Parking Service"), (1, 6, "CPS"), (1, 7, "world health organization")]
    got = folded(r.organizations(frame(spark, rows), "doc", "name", "start"))
    assert [(x[1], x[2]) for x in got] == [("World Health Organization", [2, 3, 7]), ("Chicago Public Schools", [4]), ("Central Parking Service", [5])]
    assert got[0][4] == 2


def test_fingerprints(spark):
    rows = spark.createDataFrame([(1, 9, "Main St.", "b"), (1, 4, "main st", "a"), (1, 7, "Elm", "c"), (1, None, "Elm", "d")], "doc long, start long, place string, x string")
    key = F.regexp_replace(F.lower("place"), "[^a-z ]", "")
    got = sorted(map(tuple, r.by_fingerprint(rows, "doc", key, "start", ["place", "x"]).collect()))
    assert got == [(1, "Elm", "c", 1), (1, "main st", "a", 2)]
