"""The pre-tokens of byte-level BPE for whole Arrow columns at once, without a regular expression engine.

The pattern is public_tokenizers.PATTERN:
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Each character has one of four classes; a pre-token begins where the class changes, a single space joins what follows it,
and the contractions are cut off from the letters behind them.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from itertools import chain

import numpy as np

from sparkwarden.llm._arrays import distinct_keys, span_keys

#: Bytes of text pre-tokenised at once.
CHUNK = 2 << 20
SPACE, LETTER, NUMBER, OTHER = range(4)
#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[[ord(c) for c in WHITE_SPACE]] = SPACE
        _classes.append(table)
    return _classes[0]


def pretokens(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows i to j: their bytes, the byte at which each pre-token begins (and the end), and each row's first pre-token (and the end)."""
    buf = data[offsets[i] : offsets[j]]
    rows = offsets[i : j + 1] - offsets[i]
    n = len(buf)
    if not n:
        return buf, np.zeros(1, np.int64), np.zeros(j - i + 1, np.int64)
    if buf.max() < 128:
        points, place, row_points = buf, None, rows
    else:
        head = (buf & 0xC0) != 0x80
        place = np.append(np.flatnonzero(head), n)
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        row_points = np.searchsorted(place, rows)
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)  # first character of a row
    first[row_points] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    start = run.copy()
    # the last white space before something else in its row begins a token; if it is " ", what follows doesn't
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
    start |= last
    after = np.zeros(n, bool)
    after[1:] = last[:-1] & (points[:-1] == 32)
    start &= ~after
    quote = np.flatnonzero((points == 39) & run & ~after)
    if len(quote):
        wide = np.append(points, np.zeros(3, points.dtype))
        edge = np.append(first, np.ones(3, bool))
        a, b = wide[quote + 1], wide[quote + 2]
        one = ~edge[quote + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~edge[quote + 1] & ~edge[quote + 2] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        start[quote[one | two] + 1] = False
        nxt = np.append(quote[one] + 2, quote[two] + 3)
        start[nxt[nxt < n]] = True
    begin = np.flatnonzero(start)
    row_first = np.searchsorted(begin, row_points)
    return buf, np.append(begin if place is None else place[begin], len(buf)), row_first


def cut_out(data: np.ndarray, offsets: np.ndarray, i: int, j: int, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets with further cuts around each added token in rows i to j, and how many cuts of its own each row has.

    Of added tokens at one place the longest counts; they are taken from left to right and don't overlap, nor cross rows.
    """
    raw, base = data[offsets[i] : offsets[j]].tobytes(), int(offsets[i])
    if not any(t in raw for t in added):
        return offsets[i : j + 1], np.zeros(j - i, np.int64)
    find = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)))
    cuts, count = [base], np.zeros(j - i, np.int64)
    for row, (a, b) in enumerate(zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist())):
        inner = [x for m in find.finditer(raw, a - base, b - base) for x in m.span()]
        inner = [base + x for k, x in enumerate(inner) if a < base + x < b and (k == 0 or inner[k - 1] != x)]
        count[row] = len(inner)
        cuts += [*inner, b]
    return np.array(cuts, np.int64), count


def with_added(data: np.ndarray, offsets: np.ndarray, i: int, j: int, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pretokens() of rows i to j in which each added token is one pre-token."""
    cuts, count = cut_out(data, offsets, i, j, added)
    buf, begin, first = pretokens(data, cuts, 0, len(cuts) - 1)
    if not count.any():
        return buf, begin, first
    spans = cuts - cuts[0]
    whole = [a for a, b in zip(spans[:-1].tolist(), spans[1:].tolist()) if buf[a:b].tobytes() in added]
    ends = dict(zip(spans[:-1].tolist(), spans[1:].tolist()))
    keep = np.ones(len(begin), bool)
    for a in whole:
        keep[np.searchsorted(begin, a, "right") : np.searchsorted(begin, ends[a])] = False
    left = np.concatenate([[0], np.cumsum(keep)])
    rows = np.concatenate([[0], np.cumsum(count + 1)])
    return buf, begin[keep], left[first[rows]]


def distinct(buf: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pre-tokens: the 128-bit keys of the distinct ones in order, where each is found first, and which one each pre-token is."""
    return distinct_keys(span_keys(buf, begin[:-1], begin[1:]))


class WordEncoder:
    """Byte-pair encoding of single pre-tokens by a tiktoken ranks file; `added` words have ids of their own. `limit` bounds the cache."""

    def __init__(self, path: str, limit: int = 150_000, added: dict[bytes, int] | None = None):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.added = added or {}
        self.size = max(*ranks.values(), *self.added.values(), 0) + 1
        self.ranks, self.cache, self.limit = ranks, {}, limit

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and the number of each word's ids."""
        cache, encode, ranks, added, out = self.cache, self.encoding.encode_ordinary, self.ranks, self.added, []
        if len(cache) > self.limit:
            cache.clear()
        for w in words:
            ids = cache.get(w)
            if ids is None:
                whole = added.get(w, ranks.get(w))
                ids = cache[w] = (whole,) if whole is not None else tuple(encode(w.decode()))
            out.append(ids)
        return np.fromiter(chain.from_iterable(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out))


def gather(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[...] of the given lengths, taken in the order `which`, one after another; and where each begins (and the end)."""
    begins = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=begins[1:])
    n = lengths[which]
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    return flat[np.arange(ends[-1]) + np.repeat(begins[which] - ends[:-1], n)], ends
