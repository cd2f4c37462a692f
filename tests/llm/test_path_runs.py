"""The runs of the n-gram join, measured on random pairs at the threshold that branch to the last step."""

import numpy as np
import pyarrow as pa

from sparkwarden.llm import ngram_join


def test_pairs_survive_paths_of_full_depth_as_often_as_planned():
    runs, depth, n, rng = ngram_join.runs_for(ngram_join.RECALL, ngram_join.THRESHOLD), ngram_join.DEPTH, 1500, np.random.default_rng(3)
    assert runs == 16
    places = ngram_join.places_of(runs, depth)
    a = rng.integers(0, 2**32, (n, places), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
    sketch = {2 * k: a[k].tobytes() for k in range(n)} | {2 * k + 1: b[k].tobytes() for k in range(n)}
    batch = pa.RecordBatch.from_pydict({"node": np.arange(2 * n), "sketch": pa.array([sketch[k] for k in range(2 * n)], pa.binary())})
    for step in range(depth):
        out = pa.Table.from_batches(list(ngram_join._paths(runs, depth, step, ngram_join.THRESHOLD)(iter([batch]))))
        path, node, at = (out.column(c).to_numpy() for c in ("path", "node", "at"))
        batch = pa.RecordBatch.from_pydict({"path": path, "node": node, "at": at, "sketch": pa.array([sketch[k] for k in node.tolist()], pa.binary())})
    order = np.lexsort((node, path))
    same = (path[order][1:] == path[order][:-1]) & (node[order][1:] // 2 == node[order][:-1] // 2) & (node[order][1:] != node[order][:-1])
    met = np.zeros((n, runs), bool)
    met[node[order][1:][same] // 2, at[order][1:][same] >> (depth - 1)] = True
    p = ngram_join.shared_path(0.8, depth)
    assert abs(met.mean() - p) < 0.02 and abs(p - 0.514) < 0.001
    # runs are independent: pairs of runs meet together as often as chance says
    both = (met.T.astype(float) @ met.astype(float)) / n
    assert abs(both[np.triu_indices(runs, 1)].mean() - p * p) < 0.01 and 1 - (1 - p) ** runs > ngram_join.RECALL
