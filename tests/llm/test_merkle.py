import random
from collections import Counter

import duckdb
import pytest

from tarnwick.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, node string"


def docs(n, seed=3):
    rng = random.Random(seed)
    out = [(i * 3 + 1, f"s{i % 4}", rng.choice(["en", "en", "en", "de", "é", "", None]), i, "wörd " * (i % 7)) for i in range(n)]
    out += [(5, None, "en", None, None), (5, None, "en", None, None), (5, "x", "en", 2, "other"), (None, "s", None, 3, ""), (None, "s", "zz", 3, "t")]
    rng.shuffle(out)
    return out


@pytest.fixture
def query(spark, tmp_path):
    def run(rows):
        frame = spark.createDataFrame([(d, t, g, s, n, "clash", "clash") for d, s, g, n, t in rows], SCHEMA).repartition(5)
        frame.write.parquet(f"file://{tmp_path}/documents.parquet")
        return merkle.op12_manifest(spark, f"file://{tmp_path}")

    return run


@pytest.mark.parametrize("n, bits", [(0, 12), (1, 12), (60, 12), (60, 2), (137, 1), (64, 3)])
def test_matches_brute_force(query, monkeypatch, n, bits):
    """Small blocks make block roots further appends, over several levels."""
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = docs(n)
    assert Counter(map(tuple, query(rows).collect())) == Counter(merkle.brute_force(rows))


def test_sql(query, tmp_path):
    rows = docs(40)
    got = Counter(map(tuple, query(rows).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert Counter(con.execute(merkle.OP12_SQL).fetchall()) == got


def test_empty(query):
    assert query([]).count() == 0


def test_tampering_shows(query):
    """Exactly the rows tampered with fail, and a wrong witness fails."""
    rows = query(docs(80)).collect()
    import zlib

    assert {r.verified for r in rows} == {True, False}
    assert all(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 for r in rows if not r.verified)


def test_witness_grows_with_each_append():
    """Before its sibling is complete a leaf's witness ends at the open subtree."""
    tree = merkle.Appended(8, 3)
    nodes = [merkle.hashed(str(i).encode()) for i in range(8)]
    known = []
    for node in nodes:
        tree.append(node)
        known.append(int((tree.witness[0, :, 0] > 0).sum()))
    assert known == [0, 1, 1, 2, 2, 2, 2, 3]
    root = tree.close(3)
    assert all(merkle.fold(nodes[i], tree.witness[i].tobytes())[0] == root for i in range(8))
    assert merkle.fold(nodes[0], tree.witness[1].tobytes())[0] != root
