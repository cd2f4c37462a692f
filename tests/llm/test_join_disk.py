"""What the n-gram join keeps on disk and shuffles while buckets are made."""

import numpy as np
import pyarrow as pa
import pytest

from sparkwarden.llm import _shared, ngram_join


def test_sketches_are_stored_once_while_pairs_are_found(spark, monkeypatch):
    docs = [(k, f"some words that {k // 2} of these texts have in common and more") for k in range(40)] + [(100, None), (None, "some words")]
    begun, seen, real = _shared.mark(), [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: seen.append([p for _, p, _ in _shared._written[begun:]]) or real(edges))
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(seen) == 2 and len([p for p in seen[0] if p.endswith("sketches")]) == 1
    assert not any(p.endswith("sketches") for p in seen[1])
    assert {r.doc_id: (r.class_id, r.n_copies) for r in got} == {k: (k - k % 2, 2) for k in range(40)} | {100: (100, 1), None: (None, 1)}


@pytest.mark.parametrize("step", [0, 1, 2, 3])
def test_a_step_needs_its_own_places_only(spark, step):
    runs, depth, rng = 3, 4, np.random.default_rng(step)
    sketch = rng.integers(0, 2**32, (50, ngram_join.places_of(runs, depth)), dtype=np.uint32)
    rows = [(k, s.tobytes()) for k, s in enumerate(sketch)]
    cut = spark.createDataFrame(rows, "node long, sketch binary").select("node", ngram_join._level(runs, depth, step).alias("sketch")).orderBy("node").collect()
    assert {len(r.sketch) for r in cut} == {4 * runs << step}
    path, at = rng.integers(0, 2**62, 50), rng.integers(0, runs << max(0, step - 1), 50).astype(np.int32)
    out = []
    for column in ([s for _, s in rows], [bytes(r.sketch) for r in cut]):
        batch = pa.RecordBatch.from_pydict({"path": path, "node": np.arange(50), "at": at, "sketch": pa.array(column, pa.binary())})
        out.append(pa.Table.from_batches(list(ngram_join._paths(runs, depth, step, 0.8)(iter([batch])))))
    assert out[0].equals(out[1]) and out[0].num_rows > 50
