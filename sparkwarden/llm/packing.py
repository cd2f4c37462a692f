"""Packing by concatenating and cutting: all token ids form one row, cut every `length` ids.

Ids are those of the `tokenizers` library by its defaults: an added token in a text (as <|endoftext|>) is one id, found before
the text is cut into pre-tokens.

The first pass encodes and stores each task's ids and counts them; prefix sums over the tasks' totals (one number a task) give
each task its place in the whole. In the second pass each task cuts its own ids at document ends and at multiples of `length`;
what a task holds of a sequence that begins or ends in another task is a boundary record, merged with the others by sequence id.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm import _pretok
from sparkwarden.llm._arrays import array_of, binary, chunks, text_bytes, tidy
from sparkwarden.llm._shared import stored

_encoders: dict[tuple, _pretok.WordEncoder] = {}
#: The tokenizer, and the same vocabulary as ranks.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(path: str, tokenizer: str | None = None) -> _pretok.WordEncoder:
    """The encoder of a ranks file, with the added tokens of a tokenizer file."""
    if (path, tokenizer) not in _encoders:
        added: dict[bytes, int] = {}
        if tokenizer:
            with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
                added = {t["content"].encode(): t["id"] for t in json.load(f)["added_tokens"]}
        _encoders[path, tokenizer] = _pretok.WordEncoder(path, added=added)
    return _encoders[path, tokenizer]


def _id_blocks(id_col: str, text_col: str, ranks: str, tokenizer: str | None, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, before = encoder(public_tokenizers.path(ranks), tokenizer), TaskContext.get().partitionId(), 0
        kind = np.uint16 if max(enc.size, end_id + 1) <= 1 << 16 else np.uint32
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_col))
            keys = array_of(batch.column(id_col))
            for i, j in chunks(offsets, _pretok.CHUNK):
                buf, begin, first = _pretok.with_added(data, offsets, i, j, enc.added)
                _, where, which = _pretok.distinct(buf, begin)
                raw = buf.tobytes()
                flat, n = enc.encode([raw[a:b] for a, b in zip(begin[where].tolist(), begin[where + 1].tolist())])
                ids, ends = _pretok.gather(flat, n, which)
                cuts = ends[first]
                ids = np.insert(ids.astype(kind), cuts[1:], kind(end_id))  # each document ends with end_id
                counts = np.diff(cuts) + 1
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([task], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                    "keys": pa.array([keys.slice(i, j - i).to_pylist()], pa.list_(keys.type)), "counts": binary([counts.astype(np.int64).tobytes()]), "ids": binary([ids.tobytes()]),
                })
                before += len(ids)

    return run


def id_blocks(df: DataFrame, id_col: str, text_col: str, ranks: str, end_id: int, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """First pass, stored: blocks of documents with their ids, their place within the task, and the task's base in the whole."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"part int, before long, n_ids long, keys array<{kind}>, counts binary, ids binary"
    blocks = stored(df.select(F.col(f"`{id_col}`").alias("_sw_id"), F.col(f"`{text_col}`").alias("_sw_text")).mapInArrow(_id_blocks("_sw_id", "_sw_text", ranks, tokenizer, end_id), schema), "id-blocks")
    totals = sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect())  # one row a task
    bases = dict(zip((r[0] for r in totals), accumulate((r[1] for r in totals), initial=0)))
    base = df.sparkSession.createDataFrame(list(bases.items()), "part int, base long")
    return blocks.join(F.broadcast(base), "part").withColumn("begin", F.col("base") + F.col("before")).drop("part", "base", "before")


def _dtype(ids: bytes, n: int) -> type:
    return np.uint32 if len(ids) == 4 * n and n else np.uint16


def cut(begin: int, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a block that begins at `begin`: their places in the whole, their lengths, and their documents (by number)."""
    starts = begin + np.concatenate([[0], np.cumsum(counts)])
    grid = np.arange(-(-begin // length) * length, starts[-1], length)
    at = np.union1d(starts[:-1], grid)
    return at, np.diff(np.append(at, starts[-1])), np.searchsorted(starts, at, "right") - 1


def _pieces(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts, ids, n, begin in zip(batch.column("keys"), *(batch.column(c).to_pylist() for c in ("counts", "ids", "n_ids", "begin"))):
                counts = np.frombuffer(counts, np.int64)
                wide = np.frombuffer(ids, _dtype(ids, n)).astype("<u4")
                at, size, doc = cut(begin, counts, length)
                view = memoryview(wide).cast("B")
                a = 4 * (at - begin)
                crc = [zlib.crc32(view[x:y]) for x, y in zip(a.tolist(), (a + 4 * size).tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": array_of(keys.values).take(pa.array(doc)), "start": at - (begin + np.cumsum(counts) - counts)[doc], "length": size, "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": counts[doc], "sequence_id": at // length, "offset": at % length,
                })

    return run


def _windows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, begin in zip(*(batch.column(c).to_pylist() for c in ("ids", "n_ids", "begin"))):
                wide = np.frombuffer(ids, _dtype(ids, n)).astype(np.int32)
                at = np.union1d([begin], np.arange(-(-begin // length) * length, begin + n, length))
                ends = np.append(at, begin + n)[1:] - begin
                yield pa.RecordBatch.from_pydict({
                    "sequence_id": at // length, "offset": pa.array(at % length, pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array(np.append(at - begin, n), pa.int32()), pa.array(wide)), "whole": pa.array(ends - (at - begin) == length),
                })

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0, ranks: str = RANKS, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """One row for each piece: `id_col` as doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With `tokenizer` None a text has no added tokens. A null or empty text is one piece, end_id alone. Repeated rows are packed as often as they occur, a null id stays null. A
    text longer than `length` spans sequences. An empty table gives no piece. Only the last sequence is shorter than `length`.
    """
    kind = df.schema[id_col].dataType.simpleString()
    return id_blocks(df, id_col, text_col, ranks, end_id, tokenizer).mapInArrow(_pieces(length), PIECES.replace("doc_id long", f"doc_id {kind}"))


def sequences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0, ranks: str = RANKS, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids array<int>; boundary records are merged by sequence id."""
    parts = stored(id_blocks(df, id_col, text_col, ranks, end_id, tokenizer).mapInArrow(_windows(length), "sequence_id long, offset long, ids array<int>, whole boolean"), "windows")
    merged = parts.where("not whole").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.where("whole").select("sequence_id", "ids").unionByName(merged.select("sequence_id", F.flatten("p.ids").alias("ids")))
