"""N-gram Jaccard self-join by chosen paths.

Equal texts are one node. In each of several runs every node takes a path of tokens sampled from its set of word n-grams: the
token at each step is the set's least one under a hash of the run and the step, so two sets choose the same token with a chance
equal to their similarity. Sets that share a path share a bucket; a bucket above LIMIT is split by the next token (some by two,
so that about 1/threshold paths go on), smaller ones are compared by brute force on min-hash sketches. Runs repeat until a pair
at the threshold is found with the wanted recall. The pairs so found only say which nodes may be similar: their components are
verified by exact Jaccard similarity over the whole sets of 64-bit n-gram hashes, in blocks of sets whose sizes allow the
threshold, and only verified links count.

Texts are equal if the digests of their words are (128 bits, of 128-bit word keys); a node is the row number of the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm._arrays import U, binary, chunks, gram_hashes, mixed, run_digests, text_bytes, tidy, whole_groups, word_keys, words
from sparkwarden.llm._components import components
from sparkwarden.llm._filters import join_groups, key_filter, maybe_in
from sparkwarden.llm._shared import discard, forget_shuffles, mark, stored

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Steps of a path at most, and the bucket size up to which pairs are compared at once.
DEPTH, LIMIT = 4, 256
#: Sketches that agree in this share of their first COMPARED places make a candidate; at similarity 0.8 fewer than one pair in a million agrees in less.
SKETCH_SHARE, COMPARED = 0.5, 48
#: Nodes of a component that are verified in one task against as many others.
BLOCK = 1024
NO_ID = np.iinfo(np.int64).max


def branch_share(threshold: float) -> float:
    """The share of paths that go on by two tokens, so that about 1/threshold do."""
    return (int(100 / threshold) - 100) / 100


def shared_path(threshold: float, depth: int) -> float:
    """The chance that a pair at the threshold shares one of a run's paths to `depth` tokens, each token with a place of its own."""
    rest = 1.0
    for _ in range(depth - 1):
        rest = 1 - (1 - threshold * rest) * (1 - branch_share(threshold) * threshold * rest)
    return threshold * rest


def runs_for(recall: float, threshold: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has shared a path of `depth` tokens with the chance `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - shared_path(threshold, depth)))


def places_of(runs: int, depth: int) -> int:
    """Places of a sketch: a run's paths are a binary tree of `depth` levels, and each of its nodes has one."""
    return runs * (2**depth - 1)


def _seeds(n: int) -> np.ndarray:
    return mixed(np.arange(n, dtype=U), 77) | U(1)


def _grams(word: np.ndarray, firsts: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of rows: hashes and each row's first; a row of fewer words than `gram` has one, of all its words."""
    h, first = gram_hashes(word, firsts, gram)
    n = np.diff(firsts)
    short = np.flatnonzero((n > 0) & (n < gram))
    if not len(short):
        return h, first
    own = mixed(n[short].astype(U), 41)
    for k in range(gram - 1):
        more = k < n[short]
        own[more] = mixed(own[more] ^ word[firsts[short][more] + k], 42)
    h = np.insert(h, first[short], own)
    return h, first + np.concatenate([[0], np.cumsum((n > 0) & (n < gram))])


def _sketches(gram: int, places: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, a number for each row, the digest of its words, and its sketch (null without words)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, number = _seeds(places), TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("id").to_numpy()
            for i, j in chunks(offsets):
                buf, starts, ends, firsts = words(data, offsets, i, j)
                keys = word_keys(buf, starts, ends)
                h, first = _grams(keys[:, 0], firsts, gram)
                full = np.flatnonzero(np.diff(first) > 0)
                sketch = np.empty((len(full), places), np.uint32)
                for k, seed in enumerate(seeds):
                    if len(full):
                        sketch[:, k] = np.minimum.reduceat(h * seed, first[full]) >> U(32)
                out = np.full(j - i, None, object)
                out[full] = [row.tobytes() for row in sketch]
                rows = np.arange(number, number + j - i)
                number += j - i
                yield pa.RecordBatch.from_pydict({"id": ids[i:j], "row": rows, "digest": pa.array(run_digests(keys, firsts[:-1], firsts[1:]), pa.binary()), "sketch": pa.array(out, pa.binary())})

    return run


def _matrix(column, places: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, places)


def _level(runs: int, depth: int, step: int) -> Column:
    """Of a sketch only the places of one step, run by run: all that `_paths` reads at that step."""
    tree = 2**depth - 1
    return F.concat(*[F.substring("sketch", 4 * (r * tree + (1 << step) - 1) + 1, 4 << step) for r in range(runs)])


def _paths(runs: int, depth: int, step: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Buckets (path, node) of the next step; at step 0 each run begins one. `at` is the run and, in its low `step` bits, the branches taken.

    Takes whole sketches or those cut by `_level`.
    """
    places, tree, twice = places_of(runs, depth), 2**depth - 1, round(100 * branch_share(threshold))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = len(batch.column("sketch")[0].as_py()) == 4 * places
            node, sketch = batch.column("node").to_numpy(), _matrix(batch.column("sketch"), places if whole else runs << step)
            if step == 0:
                at = np.arange(runs) * (tree if whole else 1)
                path = mixed(sketch[:, at].astype(U) + (np.arange(runs, dtype=U) << U(40)), 1)
                yield pa.RecordBatch.from_pydict({"path": path.reshape(-1).view(np.int64), "node": np.repeat(node, runs), "at": np.tile(np.arange(runs, dtype=np.int32), len(node))})
                continue
            path, own = batch.column("path").to_numpy().view(U), batch.column("at").to_numpy()
            for branch in (0, 1):
                chosen = np.flatnonzero(mixed(path, 9) % U(100) < U(100 if branch == 0 else twice))
                at = own[chosen] * 2 + branch
                place = (at >> step) * tree + (1 << step) - 1 + (at & ((1 << step) - 1)) if whole else at
                new = mixed(path[chosen] ^ mixed(sketch[chosen, place].astype(U), 20 + branch), 2)
                yield pa.RecordBatch.from_pydict({"path": new.view(np.int64), "node": node[chosen], "at": at.astype(np.int32)})

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n things' component, given links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _compare(places: int, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (a, b) that join what may be similar in each bucket of a partition sorted by path and node."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["path"]):
            path, node = table.column("path").to_numpy(), table.column("node").to_numpy()
            sketch = _matrix(table.column("sketch"), places)
            head = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            size = np.diff(np.append(head, len(path)))
            two = head[size == 2]
            near = (sketch[two] == sketch[two + 1]).sum(1) >= share * places
            out = [(node[two + 1][near], node[two][near])]
            for k, m in zip(head[size > 2].tolist(), size[size > 2].tolist()):
                s, left = sketch[k : k + m], []
                for x in range(m - 1):
                    y = np.flatnonzero((s[x + 1 :] == s[x]).sum(1) >= share * places) + x + 1
                    left.append((np.full(len(y), x), y))
                root = _forest(m, *(np.concatenate(z) for z in zip(*left)))
                joined = np.flatnonzero(root != np.arange(m))
                out.append((node[k + joined], node[k + root[joined]]))
            a, b = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return run


def _sets(gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, digest, and the set of n-gram hashes (sorted, 8 bytes each) of texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("id").to_numpy()
            for i, j in chunks(offsets):
                buf, starts, ends, firsts = words(data, offsets, i, j)
                keys = word_keys(buf, starts, ends)
                h, first = _grams(keys[:, 0], firsts, gram)
                sets = [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"id": ids[i:j], "digest": pa.array(run_digests(keys, firsts[:-1], firsts[1:]), pa.binary()), "size": np.array([len(x) for x in sets], np.int64), "grams": binary([x.tobytes() for x in sets])})

    return run


def _verify(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each block pair of a sorted partition: links of each node (a, links) and edges (a, b) that join linked nodes."""

    def compare(part: np.ndarray, node: np.ndarray, h: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in h])
        every = np.concatenate(h)
        row = np.repeat(np.arange(len(h)), size)
        order = np.argsort(every, kind="stable")
        s = every[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        column = np.cumsum(new) - 1
        count = np.bincount(column)
        shared = count[column] > 1
        column = (np.cumsum(count > 1) - 1)[column[shared]]
        row = row[order][shared]
        n, width = len(h), int(column.max(initial=-1)) + 1
        common = np.zeros((n, n), np.float32)
        step = max(1, 16_000_000 // n)
        for c in range(0, width, step):
            some = slice(*np.searchsorted(column, [c, c + step]))
            dense = np.zeros((n, min(step, width - c)), np.float32)
            dense[row[some], column[some] - c] = 1
            common += dense @ dense.T
        link = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-3
        np.fill_diagonal(link, False)
        if not same:
            link &= part[:, None] != part[None, :]
        return link.sum(1), np.argwhere(np.triu(link))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["root", "class", "x", "y"], 256):
            group, cls, x, y, node, part = (table.column(c).to_numpy() for c in ("root", "class", "x", "y", "node", "part"))
            change = np.ones(len(node), bool)
            change[1:] = (group[1:] != group[:-1]) | (cls[1:] != cls[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            head = np.flatnonzero(change)
            grams = table.column("grams")
            for k, end in zip(head.tolist(), np.append(head[1:], len(node)).tolist()):
                h = [np.frombuffer(g, U) for g in grams.slice(k, end - k).to_pylist()]
                own = node[k:end]
                links, pairs = compare(part[k:end], own, h, x[k] == y[k])
                root = _forest(len(own), pairs[:, 0], pairs[:, 1])
                joined = np.flatnonzero(root != np.arange(len(own)))
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({
                    "a": np.concatenate([own[some], own[joined]]), "b": pa.array(np.concatenate([own[some], own[root[joined]]])),
                    "links": np.concatenate([links[some], np.zeros(len(joined), np.int64)]).astype(np.int64),
                })

    return run


def _dealt(sets: DataFrame, threshold: float) -> DataFrame:
    """Sets (node, root, size, grams; stored) dealt to pairs of blocks of their component: root, class, x, y, part, node, grams.

    Sets similar by the threshold have sizes of the same class or of neighbours, a class reaching from a size to 1/threshold of it;
    so a class is compared with itself and the next one only.
    """
    step = max(math.log(1 / threshold), 0.01) * (1 + 1e-9)
    rows = sets.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / step))
    blocks = stored(rows.groupBy("root", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("own")), "blocks")
    upper = blocks.select("root", (F.col("class") - 1).alias("class"), F.col("own").alias("up"))
    lower = blocks.select("root", (F.col("class") + 1).alias("class"), F.col("own").alias("down"))
    around = blocks.join(upper, ["root", "class"], "left").join(lower, ["root", "class"], "left").na.fill(0, ["up", "down"])
    placed = rows.join(around, ["root", "class"]).withColumn("p", F.pmod(F.xxhash64("node"), F.col("own")))
    least, most = F.least("own_part", "other"), F.greatest("own_part", "other")

    def met(part, last, cls) -> DataFrame:
        each = placed.where(last > 0).select("root", cls.alias("class"), "node", "grams", part.alias("own_part"), F.explode(F.sequence(F.lit(0).cast("long"), last - 1)).alias("other"))
        return each.select("root", "class", "node", "grams", F.col("own_part").alias("part"), least.alias("x"), most.alias("y"))

    return met(F.col("p"), F.col("own") + F.col("up"), F.col("class")).unionByName(met(F.col("down") + F.col("p"), F.col("down"), F.col("class") - 1))


def _classified(df: DataFrame, id_col: str, text_col: str, gram: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Every row (id, row, digest, full: has words; null ids as NO_ID), and every node that has words: node, digest, first_id, n_copies, root, n_links."""
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = runs_for(recall, threshold)
    places = places_of(runs, DEPTH)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(text_col).alias("text"))
    begun = mark()
    sketched = stored(rows.mapInArrow(_sketches(gram, places), "id long, row long, digest binary, sketch binary"), "sketches")
    every = stored(sketched.select("id", "row", "digest", F.col("sketch").isNotNull().alias("full")), "rows")
    full = every.where("full")
    grouped = full.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    nodes = stored(grouped.select(F.col("first.row").alias("node"), "digest", F.col("first.id").alias("first_id"), "n_copies"), "nodes")
    # joins by node pick the first of equal texts; only the first step has to leave out the others, by 4 bytes a run
    sketches = sketched.where("sketch is not null").select(F.col("row").alias("node"), "sketch")
    cut = lambda step: sketches.select("node", _level(runs, DEPTH, step).alias("sketch"))

    leaves, stars, source = [], [], cut(0).join(nodes.select("node"), "node", "left_semi")
    for step in range(DEPTH):
        step_begun = mark()
        paths = stored(source.mapInArrow(_paths(runs, DEPTH, step, threshold), "path long, node long, at int"), "paths")
        sizes = stored(paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where("n > 1"), "path-sizes")
        shared = stored(join_groups(paths, sizes, "path", "n", paths.count()), "buckets")
        discard(step_begun, shared)
        leaves.append(shared.where(f"n <= {LIMIT}").select("path", "node"))
        large = shared.where(f"n > {LIMIT}")
        if large.isEmpty():
            break
        if step == DEPTH - 1:  # alike in all steps of a path; verified later, without a first comparison
            stars.append(large.where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b")))
        else:
            source = large.select("path", "node", "at").join(cut(step + 1), "node")
    met = leaves[0]
    for b in leaves[1:]:
        met = met.unionByName(b)
    width = min(places, COMPARED)
    short = sketches.select("node", F.substring("sketch", 1, 4 * width).alias("sketch"))
    maybe = met.join(short, "node").repartition(n_parts, "path").sortWithinPartitions("path", "node").mapInArrow(_compare(width, SKETCH_SHARE), "a long, b long")
    for s in stars:
        maybe = maybe.unionByName(s)
    groups = components(maybe.distinct())

    # exact similarities within each group of candidates; a large group is dealt out as pairs of blocks
    members = stored(groups.join(nodes, "node").select("node", "digest", "root", F.col("first_id").alias("id")), "members")
    discard(begun, every, nodes, members)
    some = maybe_in(rows, "id", key_filter(members, "id")).where("_sw_maybe").select("id", "text")
    sets = some.mapInArrow(_sets(gram), "id long, digest binary, size long, grams binary").join(members, ["id", "digest"]).dropDuplicates(["node"])
    begun = mark()
    placed = stored(sets.select("node", "root", "size", "grams"), "sets")
    forget_shuffles(spark)  # those of the sets, before they are dealt by another one
    dealt = _dealt(placed, threshold)
    keys = ["root", "class", "x", "y"]
    found = stored(dealt.repartition(n_parts, *keys).sortWithinPartitions(*keys, "node").mapInArrow(_verify(threshold), "a long, b long, links long"), "links")
    discard(begun, found)
    classes = components(found.where("links = 0").select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("n_links"))
    joined = nodes.join(classes, "node", "left").join(links, F.col("node") == F.col("a"), "left")
    return every, joined.select("node", "digest", "first_id", "n_copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of df: `id_col`, class_id, n_links, n_copies.

    Words are runs without ASCII white space; a text's set holds its `gram`-word shingles, or one shingle of all its words if it
    has fewer. n_links counts the different texts of similarity `threshold` or more, n_copies the rows of the same words;
    class_id is the least id among texts that links (and copies) join. Null and empty texts have no shingle, no links and no
    copies but themselves: class_id is their own id. A null id stays null and counts as the largest. Ids are integers.
    """
    begun = mark()
    every, rooted = _classified(df, id_col, text_col, gram, threshold, recall)
    full = every.where("full")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = stored(rooted.join(least, "root").select("digest", "class_id", "n_links", "n_copies"), "classes")
    discard(begun, every, named)
    null_id = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
    joined = join_groups(full.select("id", "digest"), named, "digest", "n_copies", every.count()).select("id", "class_id", "n_links", "n_copies")
    bare = every.where("not full").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return joined.unionByName(bare).select(null_id("id").alias(id_col), null_id("class_id").alias("class_id"), "n_links", "n_copies")


def _with_digests(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of rows, and `_sw_digest`, the digest of each text's words."""
    kinds = "".join(f"_sw_{k} {f.dataType.simpleString()}, " for k, f in enumerate(rows.schema))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for i, j in chunks(offsets):
                buf, starts, ends, firsts = words(data, offsets, i, j)
                digest = run_digests(word_keys(buf, starts, ends), firsts[:-1], firsts[1:])
                rest = {f"_sw_{k}": batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)}
                yield pa.RecordBatch.from_pydict(rest | {"digest": pa.array(digest, pa.binary())})

    named = rows.select(*[F.col(f"`{c}`").alias(f"_sw_{k}") for k, c in enumerate(rows.columns)], F.col(f"`{text_col}`").alias("_sw_text"))
    return named.mapInArrow(run, kinds + "digest binary").select(*[F.col(f"_sw_{k}").alias(c) for k, c in enumerate(rows.columns)], F.col("digest").alias("_sw_digest"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without those that are copies or near-duplicates of one with a smaller id; all columns stay.

    One row of each class stays, also where its ids are null or repeated; an id on other texts drops none of their rows.
    """
    begun = mark()
    every, rooted = _classified(df, id_col, text_col, GRAM, THRESHOLD, RECALL)
    keepers = rooted.groupBy("root").agg(F.min(F.struct("first_id", "node")).alias("keep"))
    named = rooted.join(keepers, "root").select("node", "digest", F.col("keep.first_id").alias("keep_id"), F.col("keep.node").alias("keep_node"))
    own = every.where("full").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).join(named, "digest")
    stays = (F.col("id") == F.col("keep_id")) & (F.col("node") == F.col("keep_node"))
    found = stored(own.where(~stays | (F.col("n") > 1)).select(F.col("id").alias("_sw_id"), F.col("digest").alias("_sw_digest"), stays.alias("_sw_stays")), "near")
    discard(begun, found)
    repeated = found.where("_sw_stays")
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.withColumn("_sw_id", F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))))

    def met(keys: DataFrame, how: str) -> DataFrame:
        some = maybe_in(rows, "_sw_id", key_filter(keys, "_sw_id")).where("_sw_maybe").drop("_sw_maybe")
        return _with_digests(some, text_col).join(keys.select("_sw_id", "_sw_digest"), ["_sw_id", "_sw_digest"], how)

    sure = maybe_in(rows, "_sw_id", key_filter(found, "_sw_id")).where("not _sw_maybe").select(*columns)
    # of repeated rows (same id, same words) the longest stays
    again = met(repeated, "left_semi").groupBy("_sw_id", "_sw_digest").agg(F.max_by(F.struct(*columns), F.char_length(F.col(text_col))).alias("row"))
    return sure.unionByName(met(found, "left_anti").select(*columns)).unionByName(again.select("row.*"))


def brute_force(docs: list[tuple[int, str | None]], gram: int = GRAM, threshold: float = THRESHOLD) -> dict[int, tuple[int, int, int]]:
    """id -> (class_id, n_links, n_copies) by comparing all different texts, for small tables with distinct ids."""
    sets, ids = {}, {}
    out = {}
    for k, t in docs:
        w = tuple((t or "").encode().split())
        if not w:
            out[k] = (k, 0, 1)
            continue
        ids.setdefault(w, []).append(k)
        sets[w] = {w[i : i + gram] for i in range(max(1, len(w) - gram + 1))}
    keys = list(sets)
    parent = list(range(len(keys)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(keys)
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and (n := len(x & y)) >= threshold * (len(x) + len(y) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for a, w in enumerate(keys):
        least[find(a)] = min(least.get(find(a), min(ids[w])), min(ids[w]))
    for a, w in enumerate(keys):
        for k in ids[w]:
            out[k] = (least[find(a)], links[a], len(ids[w]))
    return out
