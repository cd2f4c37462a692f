"""Near copies among rows whose ids are null or repeated."""

import collections

from sparkwarden.llm import ngram_join


def test_one_of_each_keeps_unrelated_rows_of_an_id(spark):
    text = lambda k: " ".join(f"{k}{n}" for n in range(60))
    rows = [(1, text("a")), (None, text("a") + " x"), (None, text("b")), (None, text("c")), (5, text("d")), (7, text("d") + " x"), (7, text("e"))]
    rows += [(None, text("f")), (None, text("f") + " x"), (9, text("g")), (9, text("g")), (9, text("h")), (None, None), (None, ""), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, (r.text or " ").split(" ")[0][:1], r.text is None) for r in ngram_join.one_of_each(df).collect())
    want = [(1, "a"), (None, "b"), (None, "c"), (5, "d"), (7, "e"), (None, "f"), (9, "g"), (9, "h"), (None, ""), (7, "")]
    assert got == collections.Counter([(k, t, False) for k, t in want] + [(None, "", True)])
    assert ngram_join.one_of_each(df.limit(0)).count() == 0
