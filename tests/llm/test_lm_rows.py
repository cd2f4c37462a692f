"""Where the language model's weights lie, and chances near 0."""

import math

import numpy as np

from sparkwarden.llm import lm


def test_a_path_meets_few_parts_of_the_table():
    mass = np.random.default_rng(1).pareto(0.8, 500) + 0.1
    path, mask, _ = lm.tree_of(mass)
    node, _, count = lm.choices(path, mask, np.zeros(500, np.int64))
    _, depth = lm._choice_places(mask)
    thing = np.repeat(np.arange(500), count)
    for rows in (lm.LEAST_ROWS, lm.MOST_ROWS):
        for context in np.random.default_rng(2).integers(0, 2**63, 20).astype(np.uint64):
            at = lm.weight_rows(node ^ context, rows)
            assert at.min() >= 0 and at.max() < rows
            # choices of one path that lie within four levels have rows of their own within 20 of each other
            same = (thing[1:] == thing[:-1]) & (depth[1:] // 4 == depth[:-1] // 4)
            apart = np.abs(at[1:] - at[:-1])[same]
            apart = np.minimum(apart, rows - apart)
            assert same.sum() > 1000 and apart.min() >= 1 and apart.max() <= 20


def test_a_chance_near_zero_has_a_logarithm():
    weights, at = np.array([0, 30, -30], np.float32), np.array([[0, 1, 2, 1, 2]])
    side, prior = np.array([True, True, True, False, False]), np.zeros(5, np.float32)
    got = lm._log10_chances(weights, at, side, prior)
    assert np.allclose(got, [math.log10(0.5), 0, -30 / math.log(10), -30 / math.log(10), 0], atol=1e-5)


def test_steps_in_place_equal_the_plain_sums():
    rng, rows = np.random.default_rng(3), 1 << 18  # more than one part
    weights, squares = rng.normal(0, 1, rows).astype(np.float32), rng.uniform(1, 2, rows).astype(np.float32)
    at, side, prior = rng.integers(0, rows, (lm.FEATURES, 5000)), rng.random(5000) < 0.4, rng.normal(0, 1, 5000).astype(np.float32)
    slope = side - 1 / (1 + np.exp(-(prior.astype(float) + weights.astype(float)[at].sum(0))))
    total = np.bincount(at.reshape(-1), weights=np.tile(slope, lm.FEATURES), minlength=rows)
    wanted = squares + total**2
    after = weights + lm.RATE * total / np.sqrt(wanted)
    lm._step(weights, squares, np.empty(rows, np.float32), at, side, prior)
    assert np.allclose(squares, wanted, rtol=1e-5) and np.allclose(weights, after, atol=1e-5)
