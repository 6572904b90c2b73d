import random
import time
import unicodedata

import pytest

from tarnwick.operators import occurrences as o


def brute(text, needle):
    """Leftmost stretches, apart from each other, that are the needle once normalised."""
    edge = lambda i: i in (0, len(text)) or not unicodedata.combining(text[i])
    out, i = [], 0
    while i < len(text):
        ends = [j for j in range(i + 1, len(text) + 1) if edge(i) and edge(j) and not text[i].isspace() and not text[j - 1].isspace() and o.normalised(text[i:j])[0] == needle]
        if ends:
            out.append((i, ends[0]))
        i = ends[0] if ends else i + 1
    return out


def test_places_match_all_stretches():
    rng = random.Random(3)
    alphabet = ["a", "b", " ", "\n", " ", "“", '"', "’", "'", "–", "-", "é", "é", "ﬁ", "f", "i"]
    found = 0
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 24)))
        needle = o.normalised("".join(rng.choices(alphabet, k=rng.randint(1, 3))))[0]
        if needle:
            want = brute(text, needle)
            assert o._places(o.normalised(text), needle, False) == want
            found += len(want)
    assert found > 200


@pytest.mark.parametrize(
    "text, needle, raw",
    [
        ("He said “stop  \n here” twice", '"stop here"', ["“stop  \n here”"]),
        ("line one\\n line two", "one line", ["one\\n line"]),
        ("Café du Monde – Paris", "Café du Monde - Paris", ["Café du Monde – Paris"]),
        ("the mayor, then the mayor.", "the mayor,", ["the mayor,"]),
        ("then the mayor spoke", "the mayor,", ["the mayor"]),
        ("ofﬁce", "i", []),
        ("the council met", "the council voted", []),
        ("", "x", []),
        (None, "x", []),
        ("text", " \n", []),
        ("text", None, []),
        ("🙂 a’b", "a'b", ["a’b"]),
    ],
)
def test_raw_spans(spark, text, needle, raw):
    texts = spark.createDataFrame([(1, text, "n")], "id long, body string, needle string")
    evidence = spark.createDataFrame([(1, needle), (1, needle), (2, "x")], "id long, needle string")
    rows = o.proven(texts, "id", "body", evidence, "needle").orderBy("start").collect()
    assert [r.raw for r in rows] == raw and all(text[r.start : r.end] == r.raw and r.needle == needle for r in rows)


def test_whole_words_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(o, "NEEDLES", 2)
    texts = spark.createDataFrame([(1, "art, the arts, smart art")], "id long, body string")
    evidence = spark.createDataFrame([(1, x) for x in ("art", "arts", "the", "smart", "none")], "id long, needle string")
    got = sorted((r.needle, r.start) for r in o.proven(texts, "id", "body", evidence, "needle", whole_words=True).collect())
    assert got == [("art", 0), ("art", 21), ("arts", 9), ("smart", 15), ("the", 5)]
    assert len(o.proven(texts, "id", "body", evidence, "needle").filter("needle = 'art'").collect()) == 4
    assert o.proven(texts.limit(0), "id", "body", evidence, "needle").count() == 0


def test_time_follows_the_length():
    def seconds(n):
        text = "ab “c”  d\n" * n
        begin = time.perf_counter()
        assert len(o._places(o.normalised(text), "'c' d", False)) == n
        return time.perf_counter() - begin

    seconds(2000)
    assert seconds(80_000) < 60 * max(seconds(8_000), 0.005)


def test_plain_texts_are_searched_as_their_normalised_copies():
    rng = random.Random(4)
    alphabet = ["a", "b", " ", "\n", " ", "\\", "n", "t", "\\n", "“", '"', "`", "’", "–", "é", "̣", "́", "´", "q̣", "\x01", "\x1c", "\U0001f642"]
    plain = found = 0
    for _ in range(6000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 24)))
        copy = o.normalised(text)
        if (whole := o._joined(text)) is not None:
            plain += 1
            assert whole == copy[0]
        for k in (1, 2, 3):
            if needle := o.normalised("".join(rng.choices(alphabet, k=k)))[0]:
                for words in (False, True):
                    want = o._places(copy, needle, words)
                    assert o._searched(text)(needle, words) == want
                    found += len(want)
    assert plain > 2000 and found > 5000


def test_a_plain_text_costs_less_than_its_normalised_copy():
    text = "Ein längerer Text – mit „Zeichen“ und\n  Zeilen. " * 20_000
    begun = time.process_time()
    places = o._searched(text)("und Zeilen.", False)
    middle = time.process_time()
    assert places == o._places(o.normalised(text), "und Zeilen.", False)
    assert 2 * (middle - begun) < time.process_time() - middle
