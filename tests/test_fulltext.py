import random
import re

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import stems
from tarnwick.operators import fulltext

# the examples that the algorithm was published with
STEMS = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size"
    " hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit"
    " radically radic differently differ analogously analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous"
    " formality formal sensitivity sensit sensibility sensibl triplicate triplic formative form formalize formal electricity electr electrical electr hopeful hope goodness good revival reviv"
    " allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt"
    " communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controlling control roll roll element element yes ye says sai"
).split()


def test_stems(spark):
    words, want = STEMS[::2], STEMS[1::2]
    frame = spark.createDataFrame([(w,) for w in [*words, "is", "naïve", "a1"]], "w string")
    got = {r.w: r.s for r in frame.select("w", stems.stem(F.col("w")).alias("s")).collect()}
    assert got == dict(zip(words, want)) | {"is": "is", "naïve": "naïve", "a1": "a1"}
    assert stems.stems_of(words) == want


def rank(text, asked, every=None):
    """By all stretches: the shortest that hold all terms, each word's or phrase's stems."""
    words = re.findall(r"[^\W_]+", text.lower())
    own = [None if w in stems.STOP_WORDS else s for w, s in zip(words, stems.stems_of(words))]
    wanted = {s for terms in every or asked for t in terms for s, _ in t}
    n = len(own)

    def holds(i, j):
        stands = lambda t: any(all(k + d <= j and own[k + d] == s for s, d in t) for k in range(i, j + 1))
        return any(all(stands(t) for t in terms) for terms in asked)

    full = [(i, j) for i in range(n) for j in range(i, n) if holds(i, j)]
    least = [(i, j) for i, j in full if not any((a, b) != (i, j) and i <= a and b <= j for a, b in full)]
    return sum(0.1 / (1 + (j - i + 1) - sum(own[k] in wanted for k in range(i, j + 1))) for i, j in least)


QUERIES = ['running dog', '"lazy dogs" fox', 'fox OR "bank of rivers"', 'jump -cat', 'dogs dogs', 'fox cats OR banks -dog', '"the fox"', "run"]


@pytest.mark.parametrize("query", QUERIES)
def test_ranks_match_all_stretches(spark, query):
    rng = random.Random(4)
    vocabulary = "the fox foxes runs running ran dog dogs lazy of bank banks river rivers jumps jumped cat big, small. it".split()
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 16))) for _ in range(60)] + ["", "Foxes of the banks of the river; a lazily running DOG.", "Lazy dogs of the lazy dog: a fox, lazy dogs"]
    docs = spark.createDataFrame([*enumerate(texts), (900, None)], "id long, body string")
    got = {r.id: r["rank"] for r in fulltext.search(docs, "id", "body", query).collect()}
    wanted = fulltext.parsed(query)
    want = {}
    for i, text in enumerate(texts):
        ok = [asked for asked, barred in wanted if not any(rank(text, [[t]]) for t in barred)]
        if ok and (r := rank(text, ok, [asked for asked, _ in wanted])):
            want[i] = r
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert want


def test_inflected_forms_match_and_dense_covers_come_first(spark):
    texts = ["the council approves budgets", "budget talks; later a councils meeting approved it", "councilman budgeted"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = fulltext.search(docs, "id", "body", "council budget").orderBy(F.desc("rank")).collect()
    assert [r.id for r in got] == [0, 1]


@pytest.mark.parametrize("query", ["", "the of", "-fox", "OR", '"" -', "!!"])
def test_queries_that_match_nothing(spark, query):
    assert fulltext.search(spark.createDataFrame([(1, "the fox")], "id long, body string"), "id", "body", query).count() == 0
