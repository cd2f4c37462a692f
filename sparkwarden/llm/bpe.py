"""Byte-level BPE over a corpus by a shuffle of distinct words.

Documents are cut into pre-tokens with their positions. Blocks of documents keep their positions as numbers into the block's own
list of distinct pre-tokens, and only these lists travel: each distinct pre-token meets all its askers in one bucket, is encoded
there once, and its ids return to the blocks, where documents are reassembled by position. Decoding joins the ids with the
table of token bytes and reassembles in the same way. Pre-tokens are told apart by 128-bit keys. The input has to give the same
rows in the same order when it is read again (a table does), as a lost task's blocks are made anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkwarden.llm import _pretok
from sparkwarden.llm._arrays import U, array_of, binary, chunks, distinct_keys, span_keys, text_bytes, tidy
from sparkwarden.llm._shared import stored
from sparkwarden.llm.packing import encoder

#: Bytes of text in a block: the more, the fewer words travel twice; it bounds a task's memory.
BLOCK = 16 << 20


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _blocks(n_buckets: int, key_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of two kinds: a block with its keys, positions and row starts (key: the block), and its distinct words in a bucket (key: the bucket)."""

    def block(at: int, keys_of: list, words: list, firsts: list, keys: list) -> pa.RecordBatch:
        lists = np.concatenate(keys_of)
        distinct, order, which = distinct_keys(lists)
        ends = np.cumsum([len(k) for k in keys_of])
        position = [which[end - len(k) : end][inverse] for k, end, inverse in zip(keys_of, ends, firsts[0])]
        raw = np.array(words, object)[order]
        # the top bits choose the bucket, so buckets are ranges of the ordered list; a bucket without words has no row
        bucket = (distinct[:, 0] >> U(32)).astype(np.int64) * n_buckets >> 32
        full, begins = np.unique(bucket, return_index=True)
        spans = list(zip(full.tolist(), begins.tolist(), np.append(begins[1:], len(bucket)).tolist()))
        rows = np.cumsum(np.concatenate([[0], *firsts[1]]))
        out = {"key": [at], "block": [at], "keys": [keys], "words": [None], "lengths": [None], "positions": [_pack(np.concatenate(position).astype(np.uint32))], "rows": [rows.astype(np.int64).tobytes()]}
        for b, x, y in spans:
            some = raw[x:y]
            for k, v in (("key", b), ("block", at), ("keys", None), ("words", zstandard.ZstdCompressor(level=3).compress(b"".join(some))), ("lengths", _pack(np.fromiter(map(len, some), np.uint32, len(some)))), ("positions", None), ("rows", None)):
                out[k].append(v)
        return pa.RecordBatch.from_pydict({"key": pa.array(out["key"], pa.int64()), "block": pa.array(out["block"], pa.int64()), "keys": pa.array(out["keys"], pa.list_(key_type)), **{k: pa.array(out[k], pa.binary()) for k in ("words", "lengths", "positions", "rows")}})

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = (TaskContext.get().partitionId() + 1) << 32, 0  # above all buckets
        state: tuple[list, list, list, list] = ([], [], [[], []], [])
        for batch in batches:
            data, offsets = text_bytes(batch.column("_sw_text"))
            ids = array_of(batch.column("_sw_id"))
            for i, j in chunks(offsets, _pretok.CHUNK):
                buf, begin, first = _pretok.pretokens(data, offsets, i, j)
                own, where, which = _pretok.distinct(buf, begin)
                raw = buf.tobytes()
                state[0].append(own)
                state[1].extend(raw[a:b] for a, b in zip(begin[where].tolist(), begin[where + 1].tolist()))
                state[2][0].append(which)
                state[2][1].append(np.diff(first))
                state[3].extend(ids.slice(i, j - i).to_pylist())
                held += len(buf) + 64 * (j - i)
                if held >= BLOCK:
                    yield block(at, *state)
                    at, held, state = at + 1, 0, ([], [], [[], []], [])
        if state[3]:
            yield block(at, *state)

    return run


def _encode_words(ranks: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All words of a partition: each distinct word is encoded once, and each block gets the ids of its words in its order."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, parts, owner_of = encoder(public_tokenizers.path(ranks)), [], []
        for batch in batches:
            for key, block, words, lengths in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "words", "lengths"))):
                if words is None:
                    continue
                raw = zstandard.ZstdDecompressor().decompress(words)
                n = _unpack(lengths, np.uint32).astype(np.int64)
                ends = np.cumsum(n)
                parts.append((raw, ends - n, ends, span_keys(np.frombuffer(raw, np.uint8), ends - n, ends)))
                owner_of.append((block, key))
        if not parts:
            return
        _, where, which = distinct_keys(np.concatenate([p[3] for p in parts]))
        base = np.cumsum([0] + [len(p[3]) for p in parts])
        owner = np.searchsorted(base, where, "right") - 1
        words = [parts[o][0][parts[o][1][k] : parts[o][2][k]] for o, k in zip(owner.tolist(), (where - base[owner]).tolist())]
        flat, n = enc.encode(words)
        for k, (block, bucket) in enumerate(owner_of):
            own = which[base[k] : base[k + 1]]
            got, _ = _pretok.gather(flat, n, own)
            yield pa.RecordBatch.from_pydict({"block": [block], "bucket": [bucket], "ids": binary([_pack(got.astype(np.uint32))]), "counts": binary([_pack(n[own].astype(np.uint32))])})

    return run


def _token_table(ranks: str) -> list[bytes]:
    """The bytes of each token id."""
    enc = encoder(public_tokenizers.path(ranks))
    table = [b""] * enc.size
    for token, rank in enc.ranks.items():
        table[rank] = token
    return table


def _assembled(block: pa.Table, answers: pa.Table) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """keys, positions, row starts, and the distinct words' ids and counts of one block."""
    if block.column("words").null_count == 0:  # a bucket's words, not a block
        return
    order = np.argsort(answers.column("bucket").to_numpy())
    ids, counts = (answers.column(c).to_pylist() for c in ("ids", "counts"))
    none = [np.zeros(0, np.uint32)]
    flat = np.concatenate(none + [_unpack(ids[k], np.uint32) for k in order])
    n = np.concatenate(none + [_unpack(counts[k], np.uint32) for k in order]).astype(np.int64)
    for k in range(block.num_rows):
        yield block.column("keys")[k].values, _unpack(block.column("positions")[k].as_py(), np.uint32), np.frombuffer(block.column("rows")[k].as_py(), np.int64), flat, n


def _spans(lengths: np.ndarray) -> list[tuple[int, int]]:
    ends = np.cumsum(lengths)
    return list(zip((ends - lengths).tolist(), ends.tolist()))


def _digests(ranks: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, out, owners = _token_table(ranks), [], []
        decimal = np.array([b"%d" % k for k in range(len(tokens))], object)
        for keys, position, rows, flat, n in _assembled(block, answers):
            owners.append(array_of(keys))
            spans = _spans(n)
            names, pieces = decimal[flat].tolist(), np.array(tokens, object)[flat].tolist()
            text = [b",".join(names[a:b]) for a, b in spans]
            back = [b"".join(pieces[a:b]) for a, b in spans]
            totals = np.concatenate([[0], np.cumsum(n[position])])[rows]
            for k in range(len(rows) - 1):
                at = position[rows[k] : rows[k + 1]].tolist()
                joined, bytes_ = b",".join([text[p] for p in at]), b"".join([back[p] for p in at])
                out.append((int(totals[k + 1] - totals[k]), hashlib.sha256(joined).hexdigest(), hashlib.sha256(bytes_).hexdigest()))
        n_tokens, ids_sha, back_sha = zip(*out) if out else ((), (), ())
        return pa.table({"doc_id": pa.concat_arrays(owners) if owners else pa.array([], block.schema.field("keys").type.value_type), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(back_sha, pa.string())})

    return run


def _ids(block: pa.Table, answers: pa.Table) -> pa.Table:
    keys_out, ids_out, offsets = [], [], [np.zeros(1, np.int64)]
    for keys, position, rows, flat, n in _assembled(block, answers):
        ids, ends = _pretok.gather(flat, n, position)
        keys_out.append(array_of(keys))
        ids_out.append(ids)
        offsets.append(ends[rows[1:]] + offsets[-1][-1])
    if not keys_out:
        return pa.table({"doc_id": pa.array([], block.schema.field("keys").type.value_type), "ids": pa.array([], pa.list_(pa.int32()))})
    return pa.table({"doc_id": pa.concat_arrays(keys_out), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), pa.array(np.concatenate(ids_out).astype(np.int32)))})


def _encoded(df: DataFrame, id_col: str, text_col: str, ranks: str, n_buckets: int | None, assemble: Callable, columns: str) -> DataFrame:
    spark = df.sparkSession
    n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    field = df.schema[id_col]
    kind = field.dataType.simpleString()
    key_type = to_arrow_type(field.dataType)
    rows = df.select(F.col(f"`{id_col}`").alias("_sw_id"), F.col(f"`{text_col}`").alias("_sw_text"))
    # one exchange, read twice: words lie with their bucket, blocks with their number
    every = rows.mapInArrow(_blocks(n_buckets, key_type), f"key long, block long, keys array<{kind}>, words binary, lengths binary, positions binary, rows binary").repartition(n_buckets, "key")
    answers = every.mapInArrow(_encode_words(ranks), "block long, bucket long, ids binary, counts binary")
    return every.groupBy("key").cogroup(answers.groupBy("block")).applyInArrow(assemble, columns.format(kind=kind))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_multi_50k.tiktoken", n_buckets: int | None = None) -> DataFrame:
    """doc_id and ids array<int> for each row of df. Null text is empty and has no ids; repeated rows and null ids stay as they are."""
    return _encoded(df, id_col, text_col, ranks, n_buckets, _ids, "doc_id {kind}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id and the bytes of each row's ids, joined with the token-byte table; null ids are empty, unknown ids fail."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(map(bytearray, _token_table(ranks)))), "token int, bytes binary")  # as many rows as the vocabulary has
    rows = stored(df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"), F.monotonically_increasing_id().alias("row")), "decode")
    joined = rows.select("doc_id", "row", F.posexplode_outer("ids").alias("at", "token")).join(F.broadcast(table), "token", "left")
    known = joined.withColumn("hex", F.when(F.col("token").isNotNull() & F.col("bytes").isNull(), F.raise_error(F.lit("unknown token id"))).otherwise(F.hex("bytes")))
    merged = known.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "hex")))).alias("p"))
    return merged.select("doc_id", F.unhex(F.array_join("p.hex", "")).alias("bytes"))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_multi_50k.tiktoken", n_buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (the bytes that these ids decode to).

    A null or empty text has 0 tokens and the digests of the empty string. An empty table gives an empty result.
    """
    return _encoded(df, id_col, text_col, ranks, n_buckets, _digests(ranks), "doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
