"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax that reaches the word.

A word's key names its class. Classes, and the words of each class, are split into two nested classes of about the same training
mass, again and again, until one word is left, so a word is a path of two-way choices. Each choice is a softmax of two:

    logit = log(mass on the right / mass on the left) + sum of weights of hashed (choice, context) features

with the word before (bigram), the two before (trigram) and the word before last (skip) as contexts. A text's probability is the
product over its tokens of their choices. Without weights a word has exactly its smoothed share of the training tokens, the base;
words never met in training share one path (unknown). For any context the probabilities of all words and unknown sum to one.

Counts of all training words are gathered by a shuffle of each block's distinct words, whose paths come back to the block. Weights
are trained by distributed gradient updates: in each round each task makes steps over all training texts of its blocks from the
common weights, and the results are averaged, each feature by the sum of the squares of its slopes in a task. The words, paths and choices grow
with the corpus; the table of weights grows with the training tokens up to MOST_ROWS, which bounds the broadcast.
"""

from __future__ import annotations

import ctypes
import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkwarden.llm._arrays import U, array_of, binary, chunks, distinct_keys, give_back, mixed, text_bytes, tidy, word_keys, words
from sparkwarden.llm._pretok import gather
from sparkwarden.llm._shared import stored

#: Bytes of text in a block.
BLOCK = 16 << 20
#: Classes at least; there are as many as shuffle partitions if those are more.
CLASSES = 256
#: Bits of a path within a class.
DEPTH = 48
#: Rows of the weight table at least and at most, and training tokens for each row.
LEAST_ROWS, MOST_ROWS, TOKENS_A_ROW = 1 << 14, 1 << 20, 8
FEATURES, ROUNDS, RATE, STEP_TOKENS = 3, 2, 0.1, 1 << 14
SLICES = 64
#: Rows of the weight table that are changed at once.
PART = 1 << 15
#: Levels of a tree whose choices share a hash but for its last LEVELS bits.
LEVELS = 4
#: Words whose choices are laid out at once.
WORDS = 1 << 16
SMOOTH = 0.1
#: Keys of the end and of unknown words.
END, UNKNOWN = np.array([0x5851F42D4C957F2D, 1], U), np.array([0x9E6C63D0876A9A47, 2], U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of each way down LEVELS levels: the numbers of its choices among their 15, and the sides taken; of 1, 2 ... levels only.
_WAYS, _LEVEL = np.arange(1 << LEVELS)[:, None], np.arange(LEVELS)
_NUMBER, _SIDE = (1 << _LEVEL) - 1 + (_WAYS >> (LEVELS - _LEVEL)), (_WAYS >> (LEVELS - 1 - _LEVEL) & 1).astype(bool)
_NUMBERS, _SIDES = ([np.ascontiguousarray(x[:, :k]) for k in range(LEVELS + 1)] for x in (_NUMBER, _SIDE))


def keep_freed() -> None:
    """Let arrays of up to 16 MB lie in the heap, and 64 MB of it stay when freed, so each step finds the memory of the one before
    (else the system maps and clears it again for every step). `give_back` still hands all of it back after each block and task.
    """
    if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "mallopt"):
        for option, value in ((-3, 16 << 20), (-1, 64 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            ctypes.CDLL(None).mallopt(option, value)


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def _unzip(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 10, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _tokens(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all tokens of rows i to j, each row with its end, and the tokens of each row."""
    buf, starts, ends, firsts = words(data, offsets, i, j)
    keys = np.insert(word_keys(_LOWER[buf], starts, ends), firsts[1:], END, axis=0)
    return keys, np.diff(firsts) + 1


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and which one each row is; one column is told apart by Arrow's hash table, the other compared."""
    met = pa.array(np.ascontiguousarray(keys[:, 0])).dictionary_encode()
    head, which = met.dictionary.to_numpy(), met.indices.to_numpy()
    order = np.argsort(head)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    which = place[which]
    found = np.stack([head[order], np.empty_like(head)], 1)
    found[which, 1] = keys[:, 1]
    if not np.array_equal(found[which, 1], keys[:, 1]):
        found, _, which = distinct_keys(keys)
    return found, which


def _blocks(key_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def block(at: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: list, held: list) -> pa.RecordBatch:
        # each block asks for the unknown word too
        found, which = _distinct(np.concatenate([UNKNOWN[None, :], *(p[0] for p in parts)]))
        ends = 1 + np.cumsum([len(p[0]) for p in parts])
        position = np.concatenate([which[e - len(p[0]) : e][p[1]] for e, p in zip(ends, parts)])
        sizes = np.concatenate([p[2] for p in parts])
        train = np.repeat(~np.array(held, bool), sizes)
        counts = np.bincount(position[train], minlength=len(found))
        return pa.RecordBatch.from_pydict({
            "block": pa.array([at], pa.int64()), "ids": pa.array([ids], pa.list_(key_type)), "held": pa.array([held], pa.list_(pa.bool_())), "sizes": binary([sizes.astype(np.int64).tobytes()]),
            "keys": binary([found.tobytes()]), "tops": binary([(found[:, 0] >> U(32)).astype(np.uint32).tobytes()]), "unknown": pa.array([int(which[0])], pa.int32()), "counts": binary([_zip(counts.astype(np.uint32))]), "positions": binary([_zip(position.astype(np.uint32))]),
        })

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        at, size, parts, ids, held = TaskContext.get().partitionId() << 32, 0, [], [], []
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys, out = array_of(batch.column("id")), batch.column("held").to_pylist()
            for i, j in chunks(offsets):
                tokens, sizes = _tokens(data, offsets, i, j)
                found, which = _distinct(tokens)
                parts.append((found, which, sizes))
                ids += keys.slice(i, j - i).to_pylist()
                held += out[i:j]
                size += int(offsets[j] - offsets[i]) + 64 * (j - i)
                if size >= BLOCK:
                    yield block(at, parts, ids, held)
                    at, size, parts, ids, held = at + 1, 0, [], [], []
        if parts:
            yield block(at, parts, ids, held)

    return run


def class_of(keys: np.ndarray, n_classes: int) -> np.ndarray:
    """The class of words by the top bits of their keys; n_classes is a power of two."""
    return (keys[:, 0] >> U(64 - (n_classes - 1).bit_length())).astype(np.int64)


def _with_slices(blocks: Callable, n_classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (key: the block), and each block's distinct words and training counts by class (key: -1 - class); a class without words has no row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            row = batch.to_pydict()
            k, n = np.frombuffer(row["keys"][0], U).reshape(-1, 2), _unzip(row["counts"][0], np.uint32)
            full, begins = np.unique(class_of(k, n_classes), return_index=True)
            spans = list(zip(begins.tolist(), np.append(begins[1:], len(k)).tolist()))
            m, at = len(full), row["block"][0]
            none = lambda c, m=m, batch=batch: pa.nulls(m, batch.schema.field(c).type)
            own = ("ids", "held", "sizes", "tops", "unknown", "positions")
            yield pa.RecordBatch.from_pydict({"key": batch.column("block"), "class": pa.nulls(1, pa.int32()), "block": batch.column("block"), **{c: batch.column(c) for c in own}, "keys": pa.nulls(1, pa.binary()), "counts": pa.nulls(1, pa.binary())})
            yield pa.RecordBatch.from_pydict({"key": pa.array(-1 - full, pa.int64()), "class": pa.array(full, pa.int32()), "block": pa.array([at] * m, pa.int64()), **{c: none(c) for c in own}, "keys": pa.array([k[a:b].tobytes() for a, b in spans], pa.binary()), "counts": pa.array([_zip(n[a:b]) for a, b in spans], pa.binary())})

    return run


def tree_of(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree over things in order by their masses (above 0): each one's path (DEPTH bits), at which of them there is a choice (bits of
    a mask, the first choice highest), and all things' logits of going right, one after another.

    Each choice parts its things where both sides have as equal masses as can be, so every level of a path has one until it ends.
    """
    n = len(mass)
    ends = np.concatenate([[0], np.cumsum(mass.astype(np.float64))])
    path, mask, found = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    begin, end = np.zeros(1, np.int64), np.full(1, n)
    for d in range(DEPTH):
        begin, end = (x[end - begin > 1] for x in (begin, end))
        if not len(begin):
            break
        half = (ends[begin] + ends[end]) / 2
        cut = np.searchsorted(ends, half)
        cut -= half - ends[cut - 1] < ends[cut] - half
        # where the levels left just suffice, the numbers of things are halved
        cut = np.where(end - begin > 1 << max(0, DEPTH - d - 2), (begin + end) // 2, np.clip(cut, begin + 1, end - 1))
        active = _ranges(begin, end - begin)
        head = np.cumsum(end - begin) - (end - begin)
        bit = active >= np.repeat(cut, end - begin)
        m = mass[active].astype(np.float64)
        right, left = np.add.reduceat(m * bit, head), np.add.reduceat(m * ~bit, head)
        mask[active] |= 1 << (DEPTH - 1 - d)
        path[active] |= bit.astype(np.int64) << (DEPTH - 1 - d)
        found.append((active, np.repeat(np.log(np.maximum(right, 1e-300)) - np.log(np.maximum(left, 1e-300)), end - begin)))
        begin, end = np.stack([begin, cut], 1).reshape(-1), np.stack([cut, end], 1).reshape(-1)
    thing = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    logits = np.concatenate([x for _, x in found]) if found else np.zeros(0)
    return path, mask, logits[np.argsort(thing, kind="stable")].astype(np.float32)


def _choice_places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The thing and the depth of each choice of a mask, thing by thing; each level has a choice until a path ends."""
    count = np.bitwise_count(mask).astype(np.int64)
    return np.repeat(np.arange(len(mask)), count), _ranges(np.zeros(len(mask), np.int64), count)


def _first_met(path: np.ndarray, own: np.ndarray, before: tuple[int, int], thing: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Which choices the thing before does not share. Things of a tree come in order of their paths, so all others repeat its choices.

    before: path and tree of the thing before the first.
    """
    parting = path ^ np.concatenate([[before[0]], path[:-1]])
    common = (DEPTH - np.frexp(parting.astype(np.float64))[1]).astype(np.int64)  # levels of both paths before they part
    common[own != np.concatenate([[before[1]], own[:-1]])] = -1
    return depth > common[thing]


def _repeated(sent: np.ndarray, first: np.ndarray, depth: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The logit of each choice from those of choices first met; last holds the last one of each depth, and is carried on."""
    order = np.argsort(depth.astype(np.uint8), kind="stable")
    own, met = depth[order], first[order]
    value = np.zeros(len(depth), np.float32)
    value[first] = sent
    value = value[order]
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    carried = head[~met[head]]
    value[carried] = last[own[carried]]
    met[carried] = True
    value = value[np.maximum.accumulate(np.where(met, np.arange(len(own)), 0))]
    if len(own):
        last[own[head]] = value[np.append(head[1:], len(own)) - 1]
    out = np.empty(len(depth), np.float32)
    out[order] = value
    return out


def choices(path: np.ndarray, mask: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of things with paths, masks and the number of the tree they are in: the choices one after another (hashes), which side each
    thing takes there (1: right), and how many choices each thing has."""
    part, way, there, count = _parts(path, mask, own)
    return (part[:, None] | _NUMBER[way].astype(U))[there], _SIDE[way][there], count


def _parts(path: np.ndarray, mask: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The choices of `choices`, LEVELS levels together: the hash of each such part of a path, its way down, which of the levels have a
    choice, and how many choices each thing has."""
    count = np.bitwise_count(mask).astype(np.int64)
    parts = -(-count // LEVELS)
    thing, begun = np.repeat(np.arange(len(path)), parts), _ranges(np.zeros(len(path), np.int64), parts) * LEVELS
    taken = path[thing]
    # the 15 choices of LEVELS levels below one lie next to each other, so a token meets few parts of the table
    part = mixed(mixed((taken >> (DEPTH - begun)).astype(U), 61) ^ (own[thing].astype(U) << U(8)) ^ begun.astype(U), 62)
    part &= ~U((1 << LEVELS) - 1)
    way = taken >> (DEPTH - LEVELS - begun) & ((1 << LEVELS) - 1)
    there = (count[thing] - begun)[:, None] > np.arange(LEVELS)
    return part, way, there, count


@tidy
def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block and class the words' counts over the whole training set, and their paths; and, as block -1 - class, the class's sums."""
    keep_freed()
    held = [x for b in batches if b.num_rows and (x := b.filter(pc.is_valid(b.column("keys")))).num_rows]  # blocks themselves lie here too
    if not held:
        return
    table = pa.Table.from_batches(held)
    classes = table.column("class").to_numpy()
    for c in np.unique(classes):
        rows = table.take(pa.array(np.flatnonzero(classes == c)))
        lists = [np.frombuffer(x, U).reshape(-1, 2) for x in rows.column("keys").to_pylist()]
        own = np.concatenate([_unzip(x, np.uint32) for x in rows.column("counts").to_pylist()])
        keys, which = _distinct(np.concatenate(lists))
        total = np.bincount(which, weights=own, minlength=len(keys)).astype(np.int64)
        leaf = np.flatnonzero((total > 0) | (keys == UNKNOWN).all(1))
        # words of like masses lie together, which leaves hardly more choices a token than there must be
        leaf = leaf[np.argsort(-total[leaf], kind="stable")]
        path, mask, logits = tree_of(total[leaf] + SMOOTH)
        at = np.full(len(keys), -1)
        at[leaf] = np.arange(len(leaf))
        n_choices = np.bitwise_count(mask).astype(np.int64)
        ends = np.cumsum([len(x) for x in lists])
        for end, size, block in zip(ends.tolist(), map(len, lists), rows.column("block").to_pylist()):
            mine = which[end - size : end]
            leaves = at[mine]
            found = leaves[leaves >= 0]
            # a logit is sent once for all words of the block that share the choice, in the order of their paths
            placed = np.sort(found)
            prior, _ = gather(logits, n_choices, placed)
            prior = prior[_first_met(path[placed], np.zeros(len(found), np.int64), (0, -1), *_choice_places(mask[placed]))]
            both = np.full((2, size), -1)
            both[:, leaves >= 0] = path[found], mask[found]
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "class": pa.array([c], pa.int32()), "totals": binary([_zip(total[mine])]), "paths": binary([_zip(both)]), "priors": binary([_zip(prior)])})
        sums = np.array([total.sum(), (total > 0).sum(), (keys == UNKNOWN).all(1).any()], np.int64)
        yield pa.RecordBatch.from_pydict({"block": pa.array([-1 - int(c)], pa.int64()), "class": pa.array([c], pa.int32()), "totals": binary([sums.tobytes()]), "paths": pa.array([None], pa.binary()), "priors": pa.array([None], pa.binary())})


CODED = "block long, ids array<{kind}>, held array<boolean>, sizes binary, tops binary, unknown int, positions binary, totals binary, paths binary, priors binary"

CODED_ORDER = ("block", "ids", "held", "sizes", "tops", "unknown", "positions", "totals", "paths", "priors")


def _coded(block: pa.Table, answers: pa.Table) -> pa.Table:
    """A block with its words' totals, paths and priors in the order of its words; or a class's sums, as a row without ids."""
    block = block.filter(pc.is_valid(block.column("sizes")))
    if not block.num_rows:  # a class's words or its sums
        some = answers.filter(pc.less(answers.column("block"), 0))
        none = {c: pa.nulls(some.num_rows, block.schema.field(c).type if c in block.schema.names else pa.binary()) for c in CODED_ORDER if c not in ("block", "totals")}
        return pa.table({"block": some.column("block"), "totals": some.column("totals")} | none).select([*CODED_ORDER])
    order = np.argsort(answers.column("class").to_numpy())
    out = {}
    for name, kind, axis in (("totals", np.int64, 0), ("paths", np.int64, 1), ("priors", np.float32, 0)):
        lists = answers.column(name).to_pylist()
        parts = [_unzip(lists[k], kind) for k in order]
        parts = [p.reshape(2, -1) for p in parts] if axis else parts
        out[name] = binary([_zip(np.concatenate(parts, axis=axis))])
    columns = {c: block.column(c) for c in ("block", "ids", "held", "sizes", "tops", "unknown", "positions")}
    return pa.table(columns | {k: pa.chunked_array([v]) for k, v in out.items()}).select([*CODED_ORDER])


def weight_rows(mixture: np.ndarray, rows: int) -> np.ndarray:
    """Rows of the weight table of mixtures of a choice and a context, both well scrambled. Mixtures are overwritten.

    Mixtures that differ in their last LEVELS bits only have rows of their own in one line of 2^LEVELS rows; it is told by the top bits of a product.
    """
    within = mixture & U((1 << LEVELS) - 1)
    mixture ^= within
    mixture *= U(0x9E3779B97F4A7C15)
    mixture >>= U(64 + LEVELS - (rows - 1).bit_length())
    mixture <<= U(LEVELS)
    mixture |= within
    return mixture.view(np.int64)


def table_of(rows: int) -> np.ndarray:
    """Zeros that begin at a multiple of 64 bytes, so a line of 2^LEVELS rows is a line of the cache."""
    raw = np.zeros(rows + 16, np.float32)
    begin = -raw.ctypes.data % 64 // 4
    return raw[begin : begin + rows]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one held at a time; memory is handed back before the next."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]
        give_back()


class _Block:
    """A coded block: its tokens, and the choices of its words in both trees."""

    def __init__(self, row: dict, n_classes: int, top: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.sizes, self.tops, self.at = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["tops"], np.uint32).astype(U), _unzip(row["positions"], np.uint32)
        self.totals = _unzip(row["totals"], np.int64)
        path, mask = _unzip(row["paths"], np.int64).reshape(2, -1)
        leaf = path >= 0
        own = (self.tops[leaf] >> U(32 - (n_classes - 1).bit_length())).astype(np.int64)
        sent = _unzip(row["priors"], np.float32)
        # words with a leaf in the order of their paths; a class and a path fit one number unless there are very many classes
        order = np.argsort(own << DEPTH | path[leaf]) if n_classes <= 1 << 15 else np.lexsort((path[leaf], own))
        path, mask, own = path[leaf][order], mask[leaf][order], own[order]
        self.word = np.empty(len(leaf), np.int64)
        self.word[np.flatnonzero(leaf)[order]] = np.arange(len(order))
        # a word without a leaf takes the unknown word's path
        self.word[~leaf] = self.word[row["unknown"]]
        self.top_node, self.top_side, self.top_n = choices(top[0], top[1], np.zeros(n_classes, np.int64))
        self.top_prior, self.top_begin, self.own = top[2], np.cumsum(self.top_n) - self.top_n, own
        self.n = np.bitwise_count(mask).astype(np.int64)
        self.begin = np.cumsum(self.n) - self.n
        # parts of paths, those of classes first, in 32 bytes each: hash, way down and the logits without weights
        self.top_parts, self.parts = (np.cumsum(x) - x for x in (-(-n // LEVELS) for n in (self.top_n, self.n)))
        n = int(-(-self.top_n // LEVELS).sum())
        self.parts += n
        self.table = np.zeros((n + int((-(-self.n // LEVELS)).sum()), 4), U)
        self.there = np.empty((len(self.table), LEVELS), bool)
        self._put(slice(0, n), _parts(top[0], top[1], np.zeros(n_classes, np.int64)), top[2])
        self.top_size, used, last = n, 0, np.zeros(DEPTH, np.float32)
        for k in range(0, len(own), WORDS):
            some = slice(k, k + WORDS)
            thing, depth = _choice_places(mask[some])
            parts = _parts(path[some], mask[some], own[some] + 1)
            first = _first_met(path[some], own[some], (int(path[k - 1]), int(own[k - 1])) if k else (0, -1), thing, depth)
            met, end = int(first.sum()), n + len(parts[0])
            self._put(slice(n, end), parts, _repeated(sent[used : used + met], first, depth, last))
            n, used = end, used + met
        # of each word where its parts begin, its choices and its class, in one number
        self.packed = (self.parts << 32 | self.n << 24 | own)[self.word]
        self.first = np.zeros(len(self.at), bool)
        self.first[np.cumsum(self.sizes) - self.sizes] = True

    def _put(self, at: slice, parts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], prior: np.ndarray) -> None:
        """Parts of paths, with the logits of their choices one after another, into the table."""
        self.table[at, 0], self.table[at, 1], self.there[at] = parts[:3]
        self.table.view(np.float32)[at, 4:][parts[2]] = prior

    @property
    def node(self) -> np.ndarray:
        """The hashes of the words' choices, one after another."""
        words = self.table[self.top_size :]
        return (words[:, :1] | _NUMBER[words[:, 1].astype(np.int64)].astype(U))[self.there[self.top_size :]]

    @property
    def side(self) -> np.ndarray:
        return _SIDE[self.table[self.top_size :, 1].astype(np.int64)][self.there[self.top_size :]]

    @property
    def prior(self) -> np.ndarray:
        return self.table.view(np.float32)[self.top_size :, 4:][self.there[self.top_size :]]

    def contexts(self, some: np.ndarray) -> np.ndarray:
        """The contexts of tokens as hashes: word before, both before, word before last; before a text stand two ends."""
        # before a text stands the end of another, before the first one, counted from behind, that of the last
        one, two = self.tops[self.at[some - 1]], self.tops[self.at[some - 2]]
        two[self.first[some]] = END[0] >> U(32)
        last = mixed(two, 14)
        return np.stack([mixed(one, 11), mixed(one ^ last, 13), last])

    def pairs(self, some: np.ndarray, rows: int, contexts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, int]]]:
        """Of tokens: rows of the weight table for each feature of each choice, its side and prior; and runs of choices that lie together,
        each as the tokens (by number) of its parts of paths and the choices of each part.

        Numbers of tokens go on for parts of their words, after those of their classes. contexts: where known.
        """
        contexts = self.contexts(some) if contexts is None else contexts
        word = self.packed[self.at[some]]
        own = word & 0xFFFFFF
        count, begin = np.concatenate([self.top_n[own], word >> 24 & 0xFF]), np.concatenate([self.top_parts[own], word >> 32])
        whole, rest = count // LEVELS, count % LEVELS
        token = np.repeat(np.arange(len(count)), whole)
        at = np.take(begin - (np.cumsum(whole) - whole), token, mode="clip")
        at += np.arange(len(at))
        runs, begin = [(token, LEVELS)], begin + whole
        for k in range(1, LEVELS):
            runs.append((np.flatnonzero(rest == k), k))
        found = np.take(self.table, np.concatenate([at, *(begin[t] for t, _ in runs[1:])]), axis=0, mode="clip")
        token, node, way = np.concatenate([t for t, _ in runs]), found[:, 0].copy(), found[:, 1].astype(np.int64)
        line = np.empty((FEATURES, len(token)), U)
        for m, context in zip(line, contexts):
            np.take(np.concatenate([context, context]), token, out=m, mode="clip")
            m ^= node
        line = weight_rows(line, rows)
        size = sum(len(t) * k for t, k in runs)
        out, side, prior = np.empty((FEATURES, size), np.int64), np.empty(size, bool), np.empty(size, np.float32)
        done = end = 0
        for t, k in runs:
            parts, choice = slice(done, done + len(t)), slice(end, end + len(t) * k)
            number = np.take(_NUMBERS[k], way[parts], axis=0, mode="clip").reshape(-1)
            part = np.arange(len(number)) // k
            for m, x in zip(out, line):
                own_rows = np.take(x[parts], part, out=m[choice], mode="clip")
                own_rows ^= number
            side[choice] = np.take(_SIDES[k], way[parts], axis=0, mode="clip").reshape(-1)
            if k == LEVELS:  # four logits at once
                prior[choice].view(np.complex128)[:] = found.view(np.complex128)[parts, 1]
            else:
                prior[choice].reshape(-1, k)[:] = found.view(np.float32)[parts, 4 : 4 + k]
            done, end = parts.stop, choice.stop
        return out, side, prior, runs

    def log10_chances(self, weights: np.ndarray) -> np.ndarray:
        """Of each token log10 of its chance."""
        chance = np.empty(len(self.at))
        for k in range(0, len(chance), STEP_TOKENS):
            own = np.arange(k, min(k + STEP_TOKENS, len(chance)))
            at, side, prior, runs = self.pairs(own, len(weights))
            each, sums, done = _log10_chances(weights, at, side, prior), [], 0
            for t, n in runs:
                sums.append(sum(each[done : done + n * len(t)].reshape(-1, n).T))
                done += n * len(t)
            both = np.bincount(np.concatenate([t for t, _ in runs]), weights=np.concatenate(sums), minlength=2 * len(own))
            chance[k : k + len(own)] = both[: len(own)] + both[len(own) :]
        return chance


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1 ... (n of them) for each, one after another."""
    out = np.repeat(begin - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


def _logits(weights: np.ndarray, at: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The logit of going right in each choice."""
    z = prior.copy()
    for rows in at:
        z += np.take(weights, rows, mode="clip")
    return np.clip(z, -40, 40, out=z)


def _probabilities(weights: np.ndarray, at: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The chance of going right in each choice."""
    z = _logits(weights, at, prior)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _log10_chances(weights: np.ndarray, at: np.ndarray, side: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """log10 of the chance of the side taken in each choice, finite however small that is."""
    z = _logits(weights, at, prior)
    z.view(np.uint32)[:] ^= side.astype(np.uint32) << np.uint32(31)  # the sign
    np.exp(z, out=z)
    z += 1
    np.log(z, out=z)
    z *= np.float32(-1 / math.log(10))
    return z


def _step(weights: np.ndarray, squares: np.ndarray, total: np.ndarray, at: np.ndarray, side: np.ndarray, prior: np.ndarray) -> None:
    """A gradient step: weights and sums of squared slopes change in place, a part that fits a cache at a time. total is scratch of their size."""
    slope = side - _probabilities(weights, at, prior)
    total.fill(0)
    for rows in at:
        np.add.at(total, rows, slope)
    for k in range(0, len(total), PART):
        t, s = total[k : k + PART], squares[k : k + PART]
        change = t * t
        s += change
        np.sqrt(s, out=change)
        np.divide(t, change, out=change)
        change *= np.float32(RATE)
        weights[k : k + PART] += change


def _train(broadcast, n_classes: int, top: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gradient steps over all training texts of the task; of each slice of the table the weights, times the sums of squared slopes, and these sums."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        start = np.frombuffer(broadcast.value, np.float32)
        rows = len(start)
        weights, squares, total = table_of(rows), np.ones(rows, np.float32), table_of(rows)
        weights[:] = start
        worked = False
        for batch in batches:
            for row in _rows(batch):
                block = _Block(row, n_classes, top)
                use = np.flatnonzero(np.repeat(~np.array(row["held"], bool), block.sizes))
                for k in range(0, len(use), STEP_TOKENS):
                    _step(weights, squares, total, *block.pairs(use[k : k + STEP_TOKENS], rows)[:3])
                    worked = True
        if worked:
            step = rows // SLICES
            for k in range(SLICES):
                part = slice(k * step, (k + 1) * step)
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "weights": binary([_zip(weights[part] * (squares[part] - 1))]), "seen": binary([_zip(squares[part] - 1)])})

    return run


@tidy
def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of slices; a sum is held for each slice of the partition."""
    weights: dict[int, np.ndarray] = {}
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, w, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "weights", "seen"))):
            weights[k] = weights.get(k, 0) + _unzip(w, np.float32).astype(np.float64)
            seen[k] = seen.get(k, 0) + _unzip(n, np.float32).astype(np.float64)
    for k in weights:
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "weights": binary([(weights[k] / np.maximum(seen[k], 1e-9)).astype(np.float32).tobytes()])})


def rows_for(tokens: int) -> int:
    """Rows of the weight table, a power of two."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << (tokens // TOKENS_A_ROW).bit_length()))


def train(coded: DataFrame, tokens: int, n_classes: int, top: tuple, rounds: int = ROUNDS) -> bytes:
    """The weights after all rounds: at most MOST_ROWS numbers, whatever the corpus."""
    spark = coded.sparkSession
    weights = np.zeros(rows_for(tokens), np.float32)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(weights.tobytes())
        parts = coded.mapInArrow(_train(held, n_classes, top), "slice int, weights binary, seen binary")
        step = len(weights) // SLICES
        for k, w in parts.repartition(SLICES, "slice").mapInArrow(_averaged, "slice int, weights binary").collect():
            weights[k * step : (k + 1) * step] = np.frombuffer(w, np.float32)
    return weights.tobytes()


def _score(broadcast, n_classes: int, top: tuple, n: int, v: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        weights = table_of(len(broadcast.value) // 4)
        weights[:] = np.frombuffer(broadcast.value, np.float32)
        for batch in batches:
            for row in _rows(batch):
                block = _Block(row, n_classes, top)
                base = np.log10((block.totals + SMOOTH) / (n + SMOOTH * (v + 1)))
                token, sizes = block.log10_chances(weights), block.sizes
                text = np.repeat(np.arange(len(sizes)), sizes)
                sums = [np.bincount(text, weights=x, minlength=len(sizes)) for x in (block.totals[block.at] > 0, base[block.at], token)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["ids"], kind), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": sizes, "n_known": sums[0].astype(np.int64),
                    "train_tokens": np.full(len(sizes), n, np.int64), "base_score": sums[1], "score": sums[2],
                })

    return run


def coded_blocks(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, tuple, int, int]:
    """The stored blocks with their words' paths; the number of classes, the tree of classes, and all training tokens and distinct ones."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_classes = max(CLASSES, 1 << (n - 1).bit_length())
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text"))
    # one exchange, read twice: words lie with their class, blocks with their number
    ids = f"array<{kind.simpleString()}>"
    schema = f"key long, class int, block long, ids {ids}, held array<boolean>, sizes binary, tops binary, unknown int, positions binary, keys binary, counts binary"
    every = rows.mapInArrow(_with_slices(_blocks(to_arrow_type(kind)), n_classes), schema).repartition(n, "key")
    answers = every.mapInArrow(_totals, "block long, class int, totals binary, paths binary, priors binary")
    cogrouped = every.groupBy("key").cogroup(answers.groupBy("block")).applyInArrow(_coded, CODED.format(kind=kind.simpleString()))
    coded = stored(cogrouped, "lm-coded", "none")
    sums = np.zeros((n_classes, 3), np.int64)
    for c, x in coded.where("block < 0").select("block", "totals").toLocalIterator():  # three numbers of each class
        sums[-1 - c] = np.frombuffer(x, np.int64)
    # an empty class keeps a leaf of hardly any mass, so that the classes' numbers are their places
    mass = sums[:, 0] + SMOOTH * sums[:, 1] + SMOOTH * sums[:, 2]
    top = tree_of(np.maximum(mass, 1e-9))
    return coded.where("block >= 0"), n_classes, top, int(sums[:, 0].sum()), int(sums[:, 1].sum())


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score (the model), log10 of the text's probability.

    Tokens are words without [\\x20\\x09-\\x0D], A-Z in lower case, and one end; a null or empty text is one end. Repeated rows
    train and score as often as they occur. With no training text all counts are 0. An empty table gives an empty result.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    coded, n_classes, top, n, v = coded_blocks(df, id_col, text_col)
    weights = spark.sparkContext.broadcast(train(coded, n, n_classes, top))
    result = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return coded.mapInArrow(_score(weights, n_classes, top, n, v, to_arrow_type(kind)), result)
