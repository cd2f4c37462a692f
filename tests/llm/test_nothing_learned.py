"""The pipeline's language stage where no row has a label."""

from sparkwarden.llm import langid


def test_lettered_texts_stay_without_labels(spark):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (None, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for least in (0.0, 0.3):
        assert {r.text for r in langid.in_a_language(df, least=least).collect()} == {"some words", "é"}
    assert {r.lang_pred for r in langid.language_id(df).collect()} == {"und"}
