"""The pipeline's language stage decides by its model: random letters and unlearned scripts go, clean texts stay."""

import random

import corpus_pipeline
from sparkwarden.llm import langid


def test_random_letters_and_other_scripts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(5)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in [20] * 20 + [100] * 20 + [1000] * 5]
    greek = [" ".join("".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(rng.randint(2, 9))) for _ in range(30))]
    odd = [(-1 - k, t, None) for k, t in enumerate(junk + greek)] + [(-1000, "xq", None), (-1001, "12", None), (-1002, None, None)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = [r.doc_id for r in corpus_pipeline.keep_languages(spark, both, "").select("doc_id").collect()]
    # what is too short to tell stays, as do all lettered texts of the table
    assert [k for k in kept if k < 0] == [-1000]
    assert sorted(k for k in kept if k >= 0) == sorted(r.doc_id for r in docs.where("text rlike '\\\\p{L}'").collect())


def test_a_language_learned_from_little_text_drops_nothing(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(60)]
    rows = [(1, " ".join(words[:20]), "xx"), (2, " ".join(words[20:]), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.in_a_language(df).count() == 2
