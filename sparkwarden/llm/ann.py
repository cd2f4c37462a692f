"""Approximate nearest neighbours by cosine: a navigable small-world graph for each shard, and the shards' results merged.

Equal vectors are one node that keeps its smallest ids, as many as an answer can use. Nodes are dealt to shards by the hash of
their vector: small tables to a few, for parallel building; larger ones to shards of up to SHARD nodes, so that their number,
and with it the work for a query, grows slowly. Each shard's graph is built once, in a task of its own, and stored as flat
neighbour arrays. Queries (different vectors, in blocks) go to every shard; of each shard's nearest nodes the best over all shards
answer, with cosines in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm._arrays import array_of, binary
from sparkwarden.llm._filters import join_groups
from sparkwarden.llm._hnsw import HNSW
from sparkwarden.llm._shared import stored

#: Nodes in a shard at most; nodes beyond which a small table gets another shard, and how many shards it gets so; queries in a block.
SHARD, SMALL, FEW, QUERY_BLOCK = 65_536, 8192, 8, 16_384
LINKS, EF_BUILD, EF_SEARCH = 16, 80, 160
INDEX = "shard long, ids array<array<bigint>>, vectors binary, links array<binary>, levels binary"


def usable(vector: Column) -> Column:
    """Whether a vector isn't null, empty or zero and has finite components only."""
    # nulls first: a null component makes the other tests null
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """Each different vector once: vector, and its `keep` smallest ids. Copies are cut down in parts before they meet."""
    rows = df.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    part = ["vector", F.pmod(F.xxhash64("id"), F.lit(256))]
    first = rows.where("id is not null").withColumns({"r": F.row_number().over(Window.partitionBy(*part).orderBy("id")), "n": F.count(F.lit(1)).over(Window.partitionBy(*part))})
    few = first.where(f"r <= {keep}").groupBy("vector").agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids"), F.sum(F.when(F.col("r") == 1, F.col("n")).otherwise(0)).alias("n"))
    return few


def shards_for(n: int) -> int:
    """The number of shards of n nodes."""
    return max(1, -(-n // SHARD), min(FEW, -(-n // SMALL)))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The graph of a partition's nodes, which are one shard's."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    batch = pa.Table.from_batches(held)
    ids = array_of(batch.column("ids"))
    vectors = np.array(batch.column("vector").to_pylist(), np.float64)
    # dealing order is no order: the graph shouldn't depend on how rows arrive
    order = np.lexsort(vectors.T[::-1])
    order = order[np.random.default_rng(3).permutation(len(order))]
    vectors = vectors[order]
    graph = HNSW(vectors, LINKS, EF_BUILD)
    yield pa.RecordBatch.from_pydict({
        "shard": array_of(batch.column("shard").slice(0, 1)), "ids": pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.list_(pa.int64()))), "vectors": binary([vectors.tobytes()]),
        "links": pa.array([[x.tobytes() for x in graph.links]], pa.list_(pa.binary())), "levels": binary([graph.levels.tobytes()]),
    })


def build_index(nodes: DataFrame) -> DataFrame:
    """The stored index of nodes (vector, ids): a row for each shard, with vectors, levels and the neighbour array of each layer."""
    shards = shards_for(nodes.count())
    dealt = nodes.select("vector", "ids", F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("shard"))
    return stored(dealt.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(_build, INDEX), "graphs", "none")


def load(row: dict) -> tuple[HNSW, np.ndarray]:
    """The graph and the vectors of an index row."""
    levels = np.frombuffer(row["levels"], np.int64)
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(levels), -1)
    links = [np.frombuffer(x, np.int32).reshape(len(levels), -1) for x in row["links"]]
    return HNSW(vectors, LINKS, EF_BUILD, links=links, levels=levels), vectors


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        kind = pa.schema([("query", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if queries.num_rows:
            q = np.array(queries.column("vector").to_pylist(), np.float64)
            names, sizes = queries.column("query").to_numpy(), queries.column("n").to_numpy()
            for row in index.to_pylist():
                graph, vectors = load(row)
                found = graph.search(q, k, EF_SEARCH)
                a, b = np.nonzero(found >= 0)
                node = found[a, b]
                x, y = q[a], vectors[node]
                score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                ids = pa.array(row["ids"], pa.list_(pa.int64())).take(pa.array(node))
                out.append(pa.table([pa.array(names[a]), pa.array(sizes[a]), array_of(ids), pa.array(score)], schema=kind))
        return pa.concat_tables(out) if out else kind.empty_table()

    return run


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest nodes found for each query (query, vector, and n, carried along): query, n, ids, score, from all shards."""
    queries = stored(queries, "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    last = index.agg(F.max("shard")).first()[0]
    every = F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))
    asked = queries.withColumns({"block": F.pmod(F.xxhash64("query"), F.lit(blocks)), "shard": F.explode(every)})
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_search(k), "query long, n long, ids array<bigint>, score double")


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k nearest other rows found.

    Nearest first, ties to the smaller id; all candidates if there are fewer than k. Vectors that are null, empty or zero, or hold
    null or non-finite components, take no part; nor do null ids. Equal vectors are each other's neighbours with cosine 1, and a
    repeated id is a candidate for no query of that id. Vectors are of one length. An empty table gives an empty result.
    """
    nodes = stored(distinct_vectors(df, id_col, vector_col, k + 1).withColumn("query", F.monotonically_increasing_id()), "vectors")
    index = build_index(nodes)
    asked = df.where((F.col(id_col) % every == 0) & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector")).distinct()
    total = nodes.agg(F.sum("n")).first()[0] or 0
    named = stored(join_groups(asked, nodes.select("vector", "query", "n"), "vector", "n", total), "asked")
    found = search(index, named.select("query", "vector", "n").dropDuplicates(["query"]), k + 1)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    top = found.withColumn("r", F.row_number().over(best)).where(f"r <= {k + 1}").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"), F.first("n").alias("n"))
    # a query vector's candidates: bounded by (k + 1) nodes of k + 1 ids
    pairs = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("s"), i.alias("id")))))
    listed = join_groups(named.select("query_id", "query"), stored(top.select("query", "n", F.array_sort(pairs).alias("pairs")), "top"), "query", "n", total)
    own = F.filter("pairs", lambda p: p["id"] != F.col("query_id"))
    out = listed.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def brute_force(rows: list[tuple[int, list[float] | None]], every: int = 50, k: int = 5) -> dict[int, list[tuple[int, float]]]:
    """query id -> its k nearest (id, cosine), exactly, for small tables."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good])
    norm = np.sqrt((x * x).sum(1)) if len(x) else x
    out = {}
    for i, v in good:
        if i % every == 0:
            s = (x @ v) / (norm * np.sqrt((v * v).sum()))
            order = [p for p in np.lexsort((ids, -s)) if ids[p] != i][:k]
            out[int(i)] = [(int(ids[p]), float(s[p])) for p in order]
    return out
