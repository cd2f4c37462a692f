"""Collocations against plain counts: pieces, cuts, ties, drops, several chunks, ranges and slices, odd rows."""

import random

import pytest

from sparkwarden.llm import collocations as co

SF = "/root/testdata/sf0.001"
SCHEMA = "lang string, text string, phrase string, n int"


def found(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in co.collocations(df, **more).collect())


def made(seed, n=60, words=("a", "b", "A", "c\x01", "d e", "é", "É", "x" * 300)):
    draw = random.Random(seed)
    gap = [" ", " ", "  ", "\t", " ", ", ", ".", "\n", "!"]
    return [(draw.choice(["en", "en", "de", None, "und"]), "".join(draw.choice(words) + draw.choice(gap) for _ in range(draw.randint(0, 200)))) for _ in range(n)]


@pytest.mark.parametrize("way", ["usual", "small chunks", "many ranges", "slices", "full filter"])
def test_equals_plain_counts(spark, monkeypatch, way):
    if way == "small chunks":
        monkeypatch.setattr(co, "CHUNK", 150)
    if way == "many ranges":
        monkeypatch.setattr(co, "STRIDE", 3)
    if way == "slices":
        monkeypatch.setattr(co, "FEWEST", 4)
        monkeypatch.setattr(co, "STRIDE", 20)
        monkeypatch.setattr(co, "PART", 1500)
    if way == "full filter":
        monkeypatch.setattr(co, "_frequent_pairs", lambda pairs: __import__("numpy").full(co.PAGES * co.PAGE_BITS // 8, 255, "uint8"))
    rows = made(1) + [("en", None), ("en", ""), (None, None), ("fr", "one two"), ("en", "   .. , ")]
    assert found(spark, rows, least=9) == co.brute_force(rows, 9) and co.brute_force(rows, 9)
    assert found(spark, rows, least=5, top=7, share=50) == co.brute_force(rows, 5, 7, 50)


def test_documents(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = found(spark, rows)
    assert got == co.brute_force(rows) and len(got) > 20


def test_no_phrases(spark):
    assert found(spark, [("en", "a b")] * 29) == [] and found(spark, [("en", None)]) == []
    assert spark.createDataFrame([], SCHEMA).transform(co.collocations).count() == 0
    assert found(spark, [("en", "a b")] * 30) == [("en", 1, "a b", 30, 30, 30, 60, 1_000_000)]


def test_counts_beyond_64_bits(spark):
    big = 4 * 10**12
    nodes = spark.createDataFrame([("en", "a", big + 1, 1), ("en", "b", big + 3, 1), ("en", "a b", big, 2)], "lang string, phrase string, f long, size int")
    totals = spark.createDataFrame([("en", 9)], "lang string, n long")
    import unittest.mock

    with unittest.mock.patch.object(co, "counted", lambda *a: (nodes, totals)):
        got = co.collocations(None).collect()
    assert [r.score for r in got] == [2_000_000 * big // (2 * big + 4)]
