"""The log-structured index of digests: runs, compaction, later batches, lookups, and digests that collide."""

import hashlib

from pyspark.sql import functions as F

from sparkwarden.llm import exact_dedup


def test_runs_merge_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE", 3)
    first = spark.createDataFrame([(k, f"t {k % 4}") for k in range(20)], "doc_id long, text string").repartition(2)
    later = spark.createDataFrame([(100, "t  1"), (101, "new"), (-1, "t1")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark)
    index.flush(first, "doc_id", "text")
    files = {}
    for r in spark.read.parquet(index.runs[0]).select(F.input_file_name().alias("f"), "digest").collect():
        files.setdefault(r.f, []).append(bytes(r.digest))
    assert len(files) >= 7 and all(len(x) <= 3 and x == sorted(x) for x in files.values())
    assert {r.group_size for r in index.compact().collect()} == {5}
    index.flush(later, "doc_id", "text")
    got = {bytes(r.digest).hex(): (r.best.id, r.group_size) for r in index.compact().collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # "t  1" is the longest original text of its group
    assert got == {sha("t0"): (0, 5), sha("t1"): (100, 7), sha("t2"): (2, 5), sha("t3"): (3, 5), sha("new"): (101, 1)}
    assert [r.best.id for r in index.lookup(sha("t1")).collect()] == [100] and index.lookup(sha("none")).count() == 0 and not index.runs


def test_a_hot_group_and_colliding_digests(spark, monkeypatch):
    rows = [(k, "hot" if k % 3 else f"t{k}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()}
    assert got == {k: (1, 4000, k == 1) if t == "hot" else (k, 1, True) for k, t in rows}
    # a digest that takes only a text's first letter: bytes decide
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.hex(F.substring(F.col(c) if isinstance(c, str) else c, 1, 1)))
    rows = [(1, "ab"), (2, "ac"), (3, "a b"), (4, "b"), (5, None)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True), 5: (5, 1, True)}
