from tarnwick.operators.components import located

CASES = [
    ("12 Main St, Springfield, IL 62701", "address", dict(address="12 Main St", city="Springfield", state="Illinois", state_code="IL", country="US", postal_code="62701")),
    ("6500 block of South Hermitage Avenue, Chicago, Ill, IL", "address", dict(address="6500 S Hermitage Ave", city="Ill", state="Illinois", state_code="IL", country="US")),
    ("Oak Ave between 1st St and 9th St, Chicago, IL", "span", dict(street="Oak Ave between 1st St and 9th St", span_start="1st St, Chicago, IL", span_end="9th St, Chicago, IL", city="Chicago", state="Illinois", state_code="IL", country="US")),
    ("Oak Ave from 1st St to 9th St, Chicago", "span", dict(street="Oak Ave from 1st St to 9th St", span_start="1st St, Chicago", span_end="9th St, Chicago", city="Chicago", country="US")),
    ("Museum (12 Elm St), Boston, MA, USA", "place", dict(name="Museum", address="12 Elm St", city="Boston", state="Massachusetts", state_code="MA", country="US")),
    ("Museum, 12 Elm St, Boston, MA", "place", dict(name="Museum", address="12 Elm St", city="Boston", state="Massachusetts", state_code="MA", country="US")),
    ("Lyon St and Oak St, Boston, MA", "intersection_road", dict(city="Boston", state="Massachusetts", state_code="MA", country="US")),
    ("Soho, London W1D 3QF, UK", "neighborhood", dict(neighborhood="Soho", city="London", country="GB", postal_code="W1D 3QF")),
    ("1 Rue X, Ottawa K1A 0B1", "address", dict(address="1 Rue X", city="Ottawa", country="CA", postal_code="K1A 0B1")),
    ("Cook, Illinois", "county", dict(city="Cook", county="Cook County", state="Illinois", state_code="IL", country="US")),
    ("Cook County, Illinois", "county", dict(county="Cook County", state="Illinois", state_code="IL", country="US")),
    ("Georgia", "state", dict(state="Georgia", state_code="GA", country="US")),
    ("Tbilisi, Georgia", "city", dict(city="Tbilisi", country="GE")),
    ("Atlanta, GA", "city", dict(city="Atlanta", state="Georgia", state_code="GA", country="US")),
    ("France", "country", dict(country="FR")),
    ("Black Sea", "natural", dict()),
    ("Midwest", "region_national", dict()),
    ("", "city", dict(country="US")),
    (None, None, dict(country="US")),
]


def test_components(spark):
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CASES)], "i int, location string, kind string")
    got = {r.i: r.components.asDict() for r in located(frame).collect()}
    for i, (location, kind, want) in enumerate(CASES):
        assert {c: v for c, v in got[i].items() if v} == want, (location, kind)
        assert None not in got[i].values()
    assert located(frame.limit(0)).count() == 0 and located(frame).columns == ["i", "location", "kind", "components"]
