"""The language model against a plain version: trees, probabilities that sum to one, and what it is without weights."""

import math

import numpy as np
import pytest

from sparkwarden.llm import lm


@pytest.mark.parametrize("n", [1, 2, 3, 7, 500])
def test_a_tree_without_weights_gives_shares(n):
    mass = np.random.default_rng(n).pareto(0.8, n) + 0.1
    path, mask, logits = lm.tree_of(mass)
    node, side, count = lm.choices(path, mask, np.zeros(n, np.int64))
    assert count.sum() == len(logits) == len(node) and len(set(node.tolist())) == n - 1
    p = np.exp(np.where(side, -np.log1p(np.exp(-logits.astype(float))), -np.log1p(np.exp(logits.astype(float)))))
    thing = np.repeat(np.arange(n), count)
    share = np.array([np.prod(p[thing == k]) for k in range(n)])
    assert np.allclose(share, mass / mass.sum(), rtol=1e-5) and abs(share.sum() - 1) < 1e-9 and count @ mass / mass.sum() < -(mass / mass.sum() * np.log2(mass / mass.sum())).sum() + 2


def _all(spark, texts, weights):
    """Blocks of a small corpus with all its words as tokens of one text, and the model's parts."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    coded, n_classes, top, n, v = lm.coded_blocks(df, "doc_id", "text")
    block = lm._Block(coded.first().asDict(), n_classes, top)
    return block, n_classes, top, n, v


def test_probabilities_of_all_words_sum_to_one_in_any_context(spark):
    texts = [f"w{k % 17} w{k % 5} w{k * k % 101} the the" for k in range(120)]
    block, n_classes, top, n, v = _all(spark, texts, None)
    weights = np.random.default_rng(4).normal(0, 1, 1 << 14).astype(np.float32)
    leaves = np.unique(block.word)
    assert len(leaves) == v + 1  # all training words and the unknown one
    for token in (0, 7, 100):
        total = 0.0
        contexts = block.contexts(np.array([token]))[:, 0]
        for leaf in leaves:
            own = block.own[leaf]
            high, low = lm._ranges(block.top_begin[[own]], block.top_n[[own]]), lm._ranges(block.begin[[leaf]], block.n[[leaf]])
            node = np.concatenate([block.top_node[high], block.node[low]])
            z = np.concatenate([block.top_prior[high], block.prior[low]]).astype(float)
            for f in range(lm.FEATURES):
                z = z + weights[lm.weight_rows(node ^ contexts[f], len(weights))]
            p = 1 / (1 + np.exp(-z))
            total += float(np.prod(np.where(np.concatenate([block.top_side[high], block.side[low]]), p, 1 - p)))
        assert abs(total - 1) < 1e-6


def test_scores_equal_a_plain_version_and_the_base_without_weights(spark, monkeypatch):
    rows = [(k, f"a b c{k % 7} d e{k % 3}") for k in range(60)] + [(100 + k, None if k else "never met words") for k in range(2)] + [(200, "a b"), (200, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    trained = lm.lm_scores(df).collect()
    monkeypatch.setattr(lm, "train", lambda coded, tokens, n_classes, top: np.zeros(lm.rows_for(tokens), np.float32).tobytes())
    for r in lm.lm_scores(df).collect():
        assert math.isclose(r.score, r.base_score, rel_tol=1e-5)
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained) and len(trained) == len(rows)
    twice = [(r.score, r.base_score) for r in trained if r.doc_id == 200]
    assert len(twice) == 2 and abs(twice[0][0] - twice[1][0]) < 1e-9


@pytest.mark.parametrize("words", [1, 3, 7, 1000])
def test_logits_sent_once_a_choice_come_back_for_each_word(words):
    rng = np.random.default_rng(words)
    sent, paths, masks, owns, wanted = [], [], [], [], []
    for own in range(4):  # a part of the words of each of four trees
        path, mask, logits = lm.tree_of(rng.zipf(1.3, 300).astype(float))
        found = np.flatnonzero(rng.random(300) < 0.4)
        count = np.bitwise_count(mask).astype(np.int64)
        prior, _ = lm.gather(logits, count, found)
        first = lm._first_met(path[found], np.zeros(len(found), np.int64), (0, -1), *lm._choice_places(mask[found]))
        sent.append(prior[first]), wanted.append(prior), paths.append(path[found]), masks.append(mask[found]), owns.append(np.full(len(found), own))
    sent, path, mask, own, wanted = map(np.concatenate, (sent, paths, masks, owns, wanted))
    assert len(sent) < len(wanted)
    last, used, out = np.zeros(lm.DEPTH, np.float32), 0, []
    for k in range(0, len(path), words):
        some = slice(k, k + words)
        thing, depth = lm._choice_places(mask[some])
        first = lm._first_met(path[some], own[some], (int(path[k - 1]), int(own[k - 1])) if k else (0, -1), thing, depth)
        out.append(lm._repeated(sent[used : used + first.sum()], first, depth, last))
        used += int(first.sum())
    assert used == len(sent) and np.array_equal(np.concatenate(out), wanted)
