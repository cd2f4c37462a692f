"""Trees with hardly more choices than there must be, and choices of tokens part by part against one by one."""

import math

import numpy as np

from sparkwarden.llm import lm


def test_paths_have_no_gaps_and_few_choices():
    mass = np.sort(np.random.default_rng(5).zipf(1.4, 3000).clip(max=10**7) + 0.1)[::-1]
    path, mask, logits = lm.tree_of(mass)
    count, share = np.bitwise_count(mask).astype(np.int64), mass / mass.sum()
    assert len(logits) == count.sum()
    assert ((mask >> (lm.DEPTH - count)) == (1 << count) - 1).all() and (mask & ((1 << (lm.DEPTH - count)) - 1) == 0).all()
    assert count @ share < -(share * np.log2(share)).sum() + 0.25


def test_a_tree_of_very_unlike_masses_ends():
    path, mask, logits = lm.tree_of(2.0 ** -np.arange(200))
    assert len(np.unique(path)) == 200 and np.isfinite(logits).all()


def test_tokens_by_parts_equal_tokens_by_choices(spark):
    texts = [f"w{k % 17} w{k % 5} w{k * k % 101} the the" for k in range(60)] + ["", "w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    coded, n_classes, top, _, _ = lm.coded_blocks(df, "doc_id", "text")
    block = lm._Block(coded.first().asDict(), n_classes, top)
    weights = np.random.default_rng(4).normal(0, 1, 1 << 14).astype(np.float32)
    got, contexts = block.log10_chances(weights), block.contexts(np.arange(len(block.at)))
    for token in range(len(block.at)):
        word = block.word[block.at[token]]
        own = block.own[word]
        high, low = lm._ranges(block.top_begin[[own]], block.top_n[[own]]), lm._ranges(block.begin[[word]], block.n[[word]])
        node, side = np.concatenate([block.top_node[high], block.node[low]]), np.concatenate([block.top_side[high], block.side[low]])
        z = np.concatenate([block.top_prior[high], block.prior[low]]).astype(float)
        for f in range(lm.FEATURES):
            z = z + weights[lm.weight_rows(node ^ contexts[f, token], len(weights))]
        assert math.isclose(got[token], -np.log10(1 + np.exp(np.where(side, -z, z))).sum(), rel_tol=1e-4, abs_tol=1e-5)


def test_keys_that_agree_in_one_column_differ():
    keys = np.array([[3, 1], [2, 5], [3, 2], [3, 1], [2, 5]], np.uint64)
    for some in (keys, keys[[0, 1, 3, 4]]):
        found, which = lm._distinct(some)
        assert np.array_equal(found[which], some) and found.tolist() == [list(x) for x in sorted(set(map(tuple, some.tolist())))]
