"""Language ID by hyperdimensional profiles.

Every letter (each code point, in lower case) has a random vector of +1 and -1 of its own, made from its number. An n-gram's
vector binds (multiplies) its letters' vectors, each permuted by its place; a text's profile bundles (adds) the vectors of all
its n-grams, and a language's prototype bundles its texts. The language of the prototype with the largest cosine wins. Bundling is
linear, so n-grams are counted first and each distinct one of a block is bound once and added with its count.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm._arrays import U, chunks, mixed, text_bytes, tidy

DIMENSIONS, GRAM, SEED = 512, 3, 20_240_601
#: Bits of a code point in an n-gram's number; 0 is the gap between words.
BITS = 21
#: Bytes of text whose n-grams are bound together, and n-grams whose vectors are held at once.
BLOCK, BOUND = 1 << 19, 8192
UNKNOWN = "und"
#: Distinct n-grams from which on a text's cosine tells whether it is in a language, the least cosine then, and n-grams at least that a
#: language is learned from. On sf0.1 texts of 48 distinct n-grams have 0.24 or more (of 192: 0.56), random letters at most 0.16 (0.26).
EVIDENCE, LEAST, LEARNED = 48, 0.2, 1000
_tables: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """The letter that each code point counts as: itself in lower case, or 0 for what isn't a letter."""
    if "letters" not in _tables:
        table = np.zeros(sys.maxunicode + 1, np.int32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                table[c] = ord(chr(c).lower()[0])
        _tables["letters"] = table
    return _tables["letters"]


def letter_vectors(letter: np.ndarray, place: int) -> np.ndarray:
    """The vectors of letters at a place of an n-gram, as bits (1: -1), a row of bytes each: permuted by one step for each place before the last."""
    words = mixed(letter.astype(U)[:, None] * U(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=U), SEED)
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(letter), -1), axis=1)
    return np.packbits(np.roll(bits, GRAM - 1 - place, axis=1), axis=1)


def gram_vectors(gram: np.ndarray) -> np.ndarray:
    """The vectors of n-grams, one row of +1 and -1 each."""
    out = np.zeros((len(gram), DIMENSIONS // 8), np.uint8)
    for place in range(GRAM):
        own, which = np.unique((gram >> BITS * (GRAM - 1 - place)) & ((1 << BITS) - 1), return_inverse=True)
        out ^= letter_vectors(own, place)[which]
    return 1 - 2 * np.unpackbits(out, axis=1).astype(np.int8)


def grams(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of rows i to j as numbers, and each row's first (and the end). Words are framed by gaps; gaps are single."""
    raw = data[offsets[i] : offsets[j]]
    rows = offsets[i : j + 1] - offsets[i]
    if len(raw) and raw.max() >= 128:
        head = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        rows = np.searchsorted(head, rows)
    else:
        points = raw
    # a gap before each row, and one at the end
    code = np.insert(letters()[points], rows, 0)
    rows = rows + np.arange(len(rows))
    keep = code > 0
    keep[1:] |= code[:-1] > 0  # the first of several gaps stays
    keep[rows] = True
    owner = np.cumsum(keep) - 1
    code, rows = code[keep].astype(np.int64), owner[rows]
    n = len(code) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    value = np.zeros(n, np.int64)
    for k in range(GRAM):
        value = (value << BITS) + code[k : k + n]
    # n-grams that cross into the next row or hold no letter don't count
    at = np.arange(n)
    row = np.searchsorted(rows, at, "right") - 1
    good = (value > 0) & (at + GRAM - 1 <= rows[np.minimum(row + 1, len(rows) - 1)])
    return value[good], np.concatenate([[0], np.cumsum(np.bincount(row[good], minlength=j - i)[: j - i])])


@tidy
def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each label in the task: the bundle of its texts, and how many there are."""
    total: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        label = np.array(batch.column("label").to_pylist(), object)
        for i, j in chunks(offsets, BLOCK):
            value, first = grams(data, offsets, i, j)
            own = np.repeat(np.arange(i, j), np.diff(first))
            for name in set(label[i:j]):
                here = label[i:j] == name
                total.setdefault(name, np.zeros(DIMENSIONS))
                total[name] += bundled(*np.unique(value[here[own - i]], return_counts=True))
                texts[name] = texts.get(name, 0) + int(here.sum())
    for name, profile in total.items():
        yield pa.RecordBatch.from_pydict({"label": [name], "profile": pa.array([profile.tolist()], pa.list_(pa.float64())), "texts": pa.array([texts[name]], pa.int64())})


def bundled(gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bundle of n-grams with their counts."""
    out = np.zeros(DIMENSIONS)
    for k in range(0, len(gram), BOUND):
        out += count[k : k + BOUND].astype(np.float64) @ gram_vectors(gram[k : k + BOUND]).astype(np.float64)
    return out


def profiles(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The profile of each row of n-grams, a row each."""
    return _profiled(value, first)[0]


def _profiled(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The profile of each row of n-grams, and how many distinct ones it has. Each distinct n-gram is bound once, some at a time."""
    n = len(first) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    gram, which = np.unique(value, return_inverse=True)
    pair, count = np.unique(which * n + np.repeat(np.arange(n), np.diff(first)), return_counts=True)  # by n-gram, then row
    which, row = pair // n, pair % n
    distinct = np.bincount(row, minlength=n)
    for k in range(0, len(gram), BOUND):
        some = slice(*np.searchsorted(which, [k, k + BOUND]))
        vectors = gram_vectors(gram[k : k + BOUND]).astype(np.float32)
        order = np.argsort(row[some], kind="stable")
        r, g, c = row[some][order], which[some][order] - k, count[some][order].astype(np.float32)
        head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else r
        for a, b in zip(head.tolist(), np.append(head[1:], len(r)).tolist()):
            out[r[a]] += c[a:b] @ vectors[g[a:b]]
    return out, distinct


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> dict[str, list[float]]:
    """The prototype of each label: the bundle of all its texts. Rows with a null label or text teach nothing."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    parts = rows.mapInArrow(_profiles, "label string, profile array<double>, texts long")
    # one vector for each label and task; the sums are made by Spark, one vector a label comes back
    each = parts.select("label", F.posexplode("profile").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"))
    return {r["label"]: [x["v"] for x in r["p"]] for r in each.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("p")).collect()}


def _judge(prototypes: dict[str, list[float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = sorted(prototypes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = np.array([prototypes[n] for n in names]).reshape(len(names), DIMENSIONS)
        p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        for batch in batches:
            data, offsets = text_bytes(batch.column("_sw_text"))
            langs, scores, kinds = [], [], []
            for i, j in chunks(offsets, BLOCK):
                value, first = grams(data, offsets, i, j)
                profile, distinct = _profiled(value, first)
                kinds.append(distinct)
                norm = np.linalg.norm(profile, axis=1)
                cosine = profile @ p.T.astype(np.float32) / np.maximum(norm, 1e-12)[:, None] if names else np.zeros((j - i, 0))
                for k in range(j - i):
                    if first[k] == first[k + 1] or not names:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(cosine[k].argmax())
                        langs.append(names[best])
                        scores.append(float(min(1.0, max(0.0, cosine[k, best]))))
            rest = {n: batch.column(n) for n in batch.schema.names if n != "_sw_text"}
            yield pa.RecordBatch.from_pydict(rest | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "grams": pa.array(np.concatenate(kinds) if kinds else [], pa.int64())})

    return run


def predict(df: DataFrame, prototypes: dict[str, list[float]], text_col: str = "text") -> DataFrame:
    """All columns of df but `text_col`, with lang_pred and score (the cosine, 0 to 1).

    A text that is null or has no letter is `und` with score 0; of equal cosines the first language in order wins.
    """
    rest = [c for c in df.columns if c != text_col]
    inner, found = _judged(df, rest, text_col, prototypes)
    return found.select(*[F.col(x).alias(c) for x, c in zip(inner, rest)], "lang_pred", "score")


def _judged(df: DataFrame, rest: list[str], text_col: str, prototypes: dict[str, list[float]]) -> tuple[list[str], DataFrame]:
    """The columns `rest` of df under names of their own (also returned), lang_pred, score and grams (distinct n-grams); so no name of df can clash."""
    inner = [f"_sw_{k}" for k in range(len(rest))]
    kinds = "".join(f"{x} {df.schema[c].dataType.simpleString()}, " for x, c in zip(inner, rest))
    rows = df.select(*[F.col(f"`{c}`").alias(x) for x, c in zip(inner, rest)], F.col(f"`{text_col}`").alias("_sw_text"))
    return inner, rows.mapInArrow(_judge(prototypes), kinds + "lang_pred string, score double, grams long")


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row, learned from the labelled rows that aren't held out.

    Works on empty tables (no rows, or, with nothing to learn from, all `und`).
    """
    prototypes = learn(df.where(~held_out(F.col(id_col))), text_col, label_col)
    rows = df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col))
    return predict(rows, prototypes, text_col)


def in_a_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", least: float = LEAST) -> DataFrame:
    """The rows of df whose text has a letter and is in a language, as far as languages could be learned.

    A text of EVIDENCE distinct n-grams or more needs a cosine of `least` with its nearest language, one of four times as many half
    as much again. Fewer n-grams can't tell a text of a language from random letters, and a language learned from little text can't
    tell its own texts; such texts stay.
    """
    learned = learn(df.where(~held_out(F.col(id_col))), text_col, label_col)
    # the length of a bundle is at most that of as many equal n-grams
    known = [n for n, p in learned.items() if np.linalg.norm(p) >= LEARNED * DIMENSIONS**0.5]
    inner, found = _judged(df, df.columns, text_col, learned or {"": [0.0] * DIMENSIONS})
    need = F.when(F.col("grams") >= 4 * EVIDENCE, 1.5 * least).when(F.col("grams") >= EVIDENCE, least).otherwise(0.0)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= need) | ~F.col("lang_pred").isin(known)))
    return kept.select(*[F.col(x).alias(c) for x, c in zip(inner, df.columns)])
