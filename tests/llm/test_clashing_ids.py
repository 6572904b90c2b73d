import pytest

from tarnwick.llm import near_copies, near_dup


@pytest.mark.parametrize("keep_one", [near_dup.keep_one, near_copies.keep_one])
def test_texts_that_share_an_id_stay_apart(spark, keep_one):
    """Of id 7 one text is a copy of id 3 and goes, the other two are documents of their own; of equal rows one stays."""
    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(3, text("a"), "z"), (7, text("a"), "x"), (7, text("b"), "y"), (7, text("c"), "w"), (7, text("c"), "v"), (9, text("b"), "u")]
    want = [(3, text("a"), "z"), (7, text("b"), "y"), (7, text("c"), "v")]
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(parts)
        kept = keep_one(frame)
        assert kept.columns == frame.columns and sorted(map(tuple, kept.collect())) == want
