"""Graphs of the size that shards have, repeated ids, and the fields of revisit records."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from sparkwarden.llm import ann, warc
from sparkwarden.llm._hnsw import HNSW

DATA = "/root/testdata/check_s/embeddings.parquet"


def test_recall_of_a_full_shard():
    if not os.path.isdir(DATA):
        pytest.skip("no larger vectors here")
    rows = pq.read_table(DATA, columns=["embedding"]).column(0).drop_null().to_pylist()
    x = np.unique(np.array([v for v in rows if v and None not in v and np.isfinite(v).all() and any(v)], np.float64), axis=0)
    x = x[np.random.default_rng(1).permutation(len(x))][: ann.SMALL]
    assert len(x) > 5000
    graph, q = HNSW(x, ann.LINKS, ann.EF_BUILD), x[::40]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(unit[::40] @ unit.T), axis=1)[:, :5]
    found = graph.search(q, 5, ann.EF_SEARCH)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.tolist(), want.tolist())]) > 0.95


def test_number_of_shards():
    assert [ann.shards_for(n) for n in (0, 1, ann.SMALL + 1, 10 * ann.SMALL, 8 * ann.SHARD, 20 * ann.SHARD)] == [1, 1, 2, 8, 8, 20]


def test_one_id_on_several_vectors(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (100, [1.0, 0.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got[100]) == [(1, 50), (2, 1)]
    # both rows of id 50 are asked, each for its own vector; id 50 is no candidate of theirs
    assert sorted(got[50]) == [(1, 2), (1, 100), (2, 1), (2, 1)]


def test_revisits_name_the_record_that_they_refer_to():
    payload = b"x" * 2000
    first, second = (warc.parse(warc.record(*a))[0] for a in ((3, "http://a/ü", payload, "response", None), (2, "http://b", payload, "revisit", 3, "http://a/ü")))
    assert second["WARC-Refers-To"] == first["WARC-Record-ID"] and second["WARC-Refers-To-Target-URI"] == first["WARC-Target-URI"] == "http://a/%C3%BC"
    assert second["WARC-Payload-Digest"] == first["WARC-Payload-Digest"] and second["X-Refers-To-Page-Id"] == "3"
