"""Hard negatives by full score sorts: rows that resemble an anchor nearly as much as its positives do, but have another label.

Anchors are a stated query set; they are taken in blocks of bounded size, each sent to the tasks that scan all rows. A task scores chunks
of its rows against each anchor, sorts the scores by score and id, and keeps the few best: first of the anchor's own label (its
positives), then, in a second scan, for each positive those of other labels between its limits, which a binary search finds. The tasks'
few best are merged by a limited window for each anchor and positive, so no task sees all rows of an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.llm._arrays import array_of, tidy
from sparkwarden.llm._shared import stored

#: Bytes of a block of anchors; rows that are scored and sorted together; scores in a tile.
BLOCK, CHUNK, TILE = 16 << 20, 8192, 1 << 20
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53
LOW, HIGH = -(2**63), 2**63 - 1
POSITIVE = "anchor int, id long, score long"
NEGATIVE = "anchor int, positive int, id long, score long"


def usable(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows that take part, as id, label, vector: nothing null, all components finite, also after scaling."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))


def _by_length(table: pa.Table, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length of vectors: row numbers, ids, labels and scaled components (whole numbers, as doubles)."""
    vector = array_of(table["vector"])
    lengths = np.diff(np.asarray(vector.offsets))
    flat = np.floor(scale * np.asarray(vector.flatten(), np.float64))
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    ids, labels = np.asarray(table["id"]), np.asarray(table["label"])
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, ids[rows], labels[rows], flat[begin[rows][:, None] + np.arange(d)]


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of at least `rows` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, held at the limits of 64 bits."""
    most = (np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)) * max(a.shape[1], 1)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: [[int(x) for x in row] for row in m]
    left, right = whole(a), whole(b)
    return np.array([[min(max(sum(map(int.__mul__, x, y)), LOW), HIGH) for y in right] for x in left], np.int64).reshape(len(a), len(b))


class Block:
    """Anchors of a block by length of their vectors: positions, ids, labels, components."""

    def __init__(self, table: pa.Table, scale: int):
        self.ids, self.labels = np.asarray(table["id"]), np.asarray(table["label"])
        self.groups = {v.shape[1]: (rows, v) for rows, _, _, v in _by_length(table, scale)}

    def scored(self, batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, ids, labels, scores) of each anchor and chunk of rows whose vectors are as long as the anchor's."""
        for table in _tables(batches, CHUNK):
            for _, ids, labels, vectors in _by_length(table, scale):
                anchors, own = self.groups.get(vectors.shape[1], (np.zeros(0, np.int64), vectors[:0]))
                step = max(1, TILE // len(ids))
                for i in range(0, len(anchors), step):
                    for a, scores in zip(anchors[i : i + step].tolist(), products(own[i : i + step], vectors)):
                        yield a, ids, labels, scores


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (-score, id)."""
    order = np.lexsort((ids, ~scores))[:k]
    return [(-s, i) for s, i in zip(scores[order].tolist(), ids[order].tolist())]


def _positives(block, scale: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, best = block.value, {}
        for a, ids, labels, scores in b.scored(batches, scale):
            same = (labels == b.labels[a]) & (ids != b.ids[a])
            if same.any():
                best[a] = sorted(best.get(a, []) + _first(scores[same], ids[same], k))[:k]
        rows = [(a, i, -s) for a, found in best.items() for s, i in found]
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["anchor", "id", "score"])

    return run


def lowest(score: int, low: int, high: int) -> int:
    """The least whole score that satisfies low * score <= high * least, within 64 bits."""
    return max(-((-low * score) // high), LOW)


def _negatives(block, positives, scale: int, k: int, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, limits, best = block.value, positives.value, {}
        for a, ids, labels, scores in b.scored(batches, scale):
            if a not in limits:
                continue
            other = np.flatnonzero(labels != b.labels[a])
            order = other[np.lexsort((ids[other], ~scores[other]))]
            falling = ~scores[order]  # ~s falls as s rises, without overflow
            for p, (score, least) in enumerate(limits[a]):
                i = int(np.searchsorted(falling, ~score, "left"))
                j = min(i + k, int(np.searchsorted(falling, ~least, "right")))
                if i < j:
                    got = [(-s, n) for s, n in zip(scores[order[i:j]].tolist(), ids[order[i:j]].tolist())]
                    best[a, p] = sorted(best.get((a, p), []) + got)[:k]
        rows = [(a, p, i, -s) for (a, p), found in best.items() for s, i in found]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["anchor", "positive", "id", "score"])

    return run


def _best(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key with their rank; Spark limits each task's rows of a key before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def _of_block(rows: DataFrame, anchors: pa.Table, scale: int, k: int, n_positives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    block = spark.sparkContext.broadcast(Block(anchors, scale))
    found = _best(rows.mapInArrow(_positives(block, scale, n_positives), POSITIVE), ["anchor"], n_positives).toArrow()  # a few for each anchor of the block
    limits: dict[int, list[tuple[int, int]]] = {}
    named = []
    for a, _, i, s in sorted(zip(*(found[c].to_pylist() for c in ("anchor", "rank", "id", "score")))):
        named.append((a, len(limits.setdefault(a, [])), int(anchors["id"][a].as_py()), i, s))
        limits[a].append((s, lowest(s, low, high)))
    sent = spark.sparkContext.broadcast(limits)
    near = _best(rows.mapInArrow(_negatives(block, sent, scale, k, low, high), NEGATIVE), ["anchor", "positive"], k)
    names = spark.createDataFrame(pa.table(dict(zip(("anchor", "positive", "anchor_id", "positive_id", "positive_score"), map(pa.array, zip(*named) if named else [[]] * 5)))).cast(pa.schema([("anchor", pa.int32()), ("positive", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])))
    out = near.join(F.broadcast(names), ["anchor", "positive"])
    out = stored(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
    for sent_out in (block, sent):
        sent_out.destroy()
    return out


def mine(rows: DataFrame, anchors: DataFrame, k: int = 5, n_positives: int = 5, low: int = 80, high: int = 100, scale: int = 256, block_bytes: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows and anchors come as `usable` gives them.

    Components x count as floor(scale * x), scores are inner products (held at the limits of 64 bits), higher first, ties by smaller
    id. Positives are an anchor's n_positives best rows of its label with another id; negatives of a positive are the k best of
    other labels with low * positive_score <= high * score <= high * positive_score. Vectors meet only vectors of their length. Repeated
    rows count each as a row of its own, and once as an anchor. Anchors without a positive or a negative give no rows.
    """
    anchors = stored(anchors.select("id", "label", "vector").distinct(), "anchors")
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vector") + 3), F.lit(0)).alias("numbers")).first()
    blocks = max(1, -(-8 * size["numbers"] // block_bytes))
    out = None
    for b in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)) == b)
        part = _of_block(rows, own.orderBy("id", "label").toArrow(), scale, k, n_positives, low, high)  # about block_bytes of them
        out = part if out is None else out.unionByName(part)
    return out


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, noise: int = 7, labels: int = 10) -> DataFrame:
    """mine() for all rows of df with every `every`-th id as an anchor; each `noise`-th id has the next label first.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do those whose components aren't
    finite once scaled. An empty table gives an empty result. Only the three named columns are read.
    """
    rows = usable(df, id_col, label_col, vector_col, 256)
    rows = rows.withColumn("label", F.when(F.col("id") % noise == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    return mine(rows, rows.where(F.col("id") % every == 0))


def brute_force(rows: list[tuple[int, int, list[float]]], anchors: list[tuple[int, int, list[float]]], k: int = 5, n_positives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> list[tuple]:
    """What mine gives, sorted, from every pair in turn (id, label, vector)."""
    import math

    whole = lambda v: [math.floor(scale * x) for x in v]
    out, rows = [], [(i, lab, whole(v)) for i, lab, v in rows]
    for a, label, v in {(i, lab, tuple(v)) for i, lab, v in anchors}:
        v = whole(v)
        scored = sorted((-min(max(sum(x * y for x, y in zip(v, w)), LOW), HIGH), i, lab) for i, lab, w in rows if len(w) == len(v))
        for s, i, _ in [x for x in scored if x[2] == label and x[1] != a][:n_positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= high * -x[0] <= high * -s][:k]
            out += [(a, i, r, n, -s, -t) for r, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND len(a.q) = len(b.q)),
positives AS (
  SELECT a, b AS p, score AS ps FROM scored WHERE same AND a != b QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
negatives AS (
  SELECT p.a, p.p, p.ps, s.b, s.score, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.b) AS r
  FROM positives p JOIN scored s ON s.a = p.a AND NOT s.same AND 80 * p.ps <= 100 * s.score AND s.score <= p.ps)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, score AS negative_score
FROM negatives WHERE r <= 5
"""
