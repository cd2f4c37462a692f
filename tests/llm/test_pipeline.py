"""The corpus pipeline against brute-force versions of its filtering stages."""

import corpus_pipeline
from sparkwarden.llm import exact_dedup, ngram_join, secret_scan
from sparkwarden.llm._shared import stored


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        frames.append(docs)
    assert all(f.columns == columns for f in frames[:-1])
    best: dict[str, tuple[int, int]] = {}
    for k, t in rows:
        if any(c.isalpha() for c in t or ""):
            key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
            best[key] = min(best.get(key, (0, k)), (-len(t), k))
    kept = {k for _, k in best.values()}
    assert {r.doc_id for r in frames[1].collect()} == kept
    classes = ngram_join.brute_force([(k, t) for k, t in rows if k in kept])
    assert {r.doc_id for r in frames[2].collect()} == {c for c, _, _ in classes.values()}
    assert frames[3].count() == frames[2].count()
    assert {r.doc_id for r in frames[4].collect()} == {r.doc_id for r in frames[2].collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] and exact_dedup and secret_scan
