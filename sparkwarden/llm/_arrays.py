"""Whole Arrow columns of text as numpy arrays: words, hashes of words and of word n-grams."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 2 << 20
U = np.uint64

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def give_back() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches that hands freed memory back when its task ends: Python workers live on, and later tasks need it."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def array_of(column) -> pa.Array:
    """One Arrow array from an array or chunked array."""
    if isinstance(column, pa.ChunkedArray):
        return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null is empty."""
    column = array_of(column)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `size` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of rows i to j: the rows' bytes, starts and ends of words there, and each row's first word."""
    buf = data[offsets[i] : offsets[j]]
    rows = offsets[i : j + 1] - offsets[i]
    if not len(buf):
        none = np.zeros(0, np.int64)
        return buf, none, none, np.zeros(j - i + 1, np.int64)
    ink = np.empty(len(buf) + 1, bool)
    np.logical_not(_WHITE[buf], out=ink[1:])
    ink[0] = False
    begin, end = ink[1:] & ~ink[:-1], np.empty(len(buf), bool)
    end[:-1] = ink[1:-1] & ~ink[2:]
    end[-1] = ink[-1]
    cuts = rows[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    begin[cuts] = ink[1:][cuts]
    end[cuts - 1] = ink[1:][cuts - 1]
    starts = np.flatnonzero(begin)
    return buf, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, rows)


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values, another one for each seed."""
    h = h + U((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


#: Spans up to this many bytes are hashed together, eight bytes at a time; longer ones each by BLAKE2b.
LONG_SPAN = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def span_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit keys of byte spans buf[start:end], as two columns of 64 bits.

    Each column scrambles in eight bytes after another with seeds of its own; there is no algebra between places, as a polynomial
    has it, so no periodic or self-similar text makes keys meet.
    """
    n = ends - starts
    out = np.empty((len(n), 2), U)
    out[:, 0], out[:, 1] = mixed(n.astype(U), 31), mixed(n.astype(U), 32)
    live = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    if len(live):
        wide = np.concatenate([buf, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(buf) + 1,), "<u8", wide, strides=(1,)).copy()
    at = 0
    while len(live):
        left = n[live] - at
        block = eight[starts[live] + at] & _MASKS[np.minimum(left, 8)]
        out[live, 0], out[live, 1] = mixed(out[live, 0] ^ block, 33), mixed(out[live, 1] ^ block, 34)
        live, at = live[left > 8], at + 8
    for k in np.flatnonzero(n > LONG_SPAN).tolist():
        out[k] = np.frombuffer(hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=16).digest(), U)
    return out


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of two columns in order, where each is found first, and which one each row is."""
    head, where, which = np.unique(keys[:, 0], return_index=True, return_inverse=True)
    if np.array_equal(keys[where, 1][which], keys[:, 1]):
        return keys[where], where, which
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    s = keys[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]).any(1)])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    where = order[np.flatnonzero(new)]
    return keys[where], where, which


def word_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit keys of words by their bytes."""
    return span_keys(buf, starts, ends)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: the first column of their keys."""
    return span_keys(buf, starts, ends)[:, 0]


def run_digests(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """16-byte BLAKE2b digests of runs of words, by the words' keys."""
    view = memoryview(np.ascontiguousarray(keys)).cast("B")
    return [hashlib.blake2b(view[16 * a : 16 * b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())]


def _joined(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    return mixed(mixed(a, seed) ^ b, seed + 1)


def gram_hashes(word: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words within rows, and the first n-gram of each row (with the total at the end).

    An n-gram joins its parts of 2, 4, 8 ... words.
    """
    count = np.maximum(np.diff(firsts) - n + 1, 0)
    first = np.zeros(len(firsts), np.int64)
    np.cumsum(count, out=first[1:])
    h, power, width = None, word, 0
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            if h is None:
                h = power
            else:
                m = min(len(h) - (1 << bit), len(power))
                h = _joined(power[: max(m, 0)], h[1 << bit : (1 << bit) + max(m, 0)], 51 + 2 * bit) if m > 0 else h[:0]
            width += 1 << bit
        if len(power) > 1 << bit:
            power = _joined(power[: -(1 << bit)], power[1 << bit :], 81 + 2 * bit)
        else:
            power = power[:0]
    at = np.arange(first[-1]) + np.repeat(firsts[:-1] - first[:-1], count)
    return h[at], first


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 14) -> Iterator[pa.Table]:
    """Tables of some `rows` rows that never part rows of equal keys; the batches come sorted by the keys. Only one table is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            x = table.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        cut = np.flatnonzero(change)
        if len(cut):
            at = int(cut[-1]) + 1
            yield table.slice(0, at)
            held = table.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def binary(parts) -> pa.Array:
    """An Arrow column of binary values."""
    return pa.array(parts, pa.large_binary() if sum(map(len, parts)) > 1 << 30 else pa.binary())
