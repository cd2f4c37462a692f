"""Hard negatives against every pair in turn: ties, repeated rows, several blocks, lengths and sizes of vectors, rows that take no part."""

import random

import numpy as np
import pytest

from sparkwarden.llm import hard_negatives as hn

SCHEMA = "id long, label long, vector array<double>"


def mined(spark, rows, anchors, parts=4, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in hn.mine(df, spark.createDataFrame(anchors, SCHEMA), **more).collect())


@pytest.mark.parametrize("block_bytes", [hn.BLOCK, 400])
def test_equals_every_pair(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(hn, "CHUNK", 20)
    monkeypatch.setattr(hn, "TILE", 40)
    draw = random.Random(5)
    rows = [(k, draw.randrange(3), [draw.randint(-2, 3) / 4 for _ in range(draw.choice([3, 3, 3, 2, 0]))]) for k in range(200)]
    rows += [rows[7]] * 4 + [(7, 1, rows[7][2]), (7, 2, [0.5, 0.25, 0.75])]  # repeated rows, and one id with several labels and vectors
    anchors = rows[::9] + [rows[0], rows[7]]
    assert mined(spark, rows, anchors, block_bytes=block_bytes) == hn.brute_force(rows, anchors)
    assert mined(spark, rows, anchors, k=2, n_positives=3, low=50, high=90, block_bytes=block_bytes) == hn.brute_force(rows, anchors, 2, 3, 50, 90)


def test_large_components_are_exact_and_held_at_64_bits(spark):
    draw = random.Random(6)
    rows = [(k, k % 2, [draw.choice([1e5, 2.0**40, -(2.0**40), 1e300, 3.0, 2.0**31 + 1]) * draw.random() for _ in range(3)]) for k in range(60)]
    assert mined(spark, rows, rows[:20]) == hn.brute_force(rows, rows[:20])
    a, b = np.array([[3e7, 3e7 + 1]]), np.array([[3e8, 3e8 - 1], [1.0, 2.0]])
    assert hn.products(a, b).tolist() == [[30000000 * 300000000 + 30000001 * 299999999, 90000002]]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, k % 3, [float(k % 5), 1.0, k / 7]) for k in range(301)]
    odd = [(None, 1, [1.0, 2.0, 3.0]), (100, None, [1.0, 2.0, 3.0]), (200, 1, None), (300, 1, [1.0, None, 2.0]), (400, 1, [nan, 1.0, 1.0]), (500, 1, [inf, 1.0, 1.0]), (600, 1, [1e307, 1.0, 1.0])]
    schema = "vec_id long, label int, embedding array<double>, score int, rank string, anchor_id string"
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows + odd], schema).repartition(3)
    changed = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in rows]
    got = sorted(tuple(r) for r in hn.hard_negatives(df).collect())
    assert got == hn.brute_force(changed, [r for r in changed if r[0] % 100 == 0]) and got
    assert hn.hard_negatives(df.limit(0)).count() == 0 and hn.hard_negatives(df.where("vec_id = 100")).count() == 0
