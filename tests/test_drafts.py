"""The words that merges are drafted from."""

from rippleframe.operators import vocabulary


def test_drafts_look_at_rare_words(spark):
    rows = spark.createDataFrame([(f"w{k}", 1000 - k) for k in range(900)], "word string, n long")
    found = vocabulary._draft_words(rows, 100)
    assert [r.n for r in found[:50]] == list(range(1000, 950, -1)) and len({r.word for r in found}) == len(found) <= 100
    assert len(found) > 60 and all(r.n > 1000 for r in found[50:])  # weights of those they stand for
