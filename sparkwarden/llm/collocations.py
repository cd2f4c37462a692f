"""Collocations from count tries: phrases of two to four words that occur together more often than their parts would suggest.

A task counts the words of a chunk of texts and what follows them in a trie of limited depth, kept as a sorted array of nodes, and
serialises it in runs, one for each range of phrases. Runs of a range meet and are merged; nodes of enough occurrences stay. The trie is
made in two levels: words and pairs first; then, under pairs that a filter of all frequent pairs lets pass, phrases of three and four
words, as a phrase is never more frequent than the pairs in it. The merged nodes are a trie again: a walk from a phrase to its parents
gives the counts of its left parts, suffix links (the phrase without its first word) those of its right parts.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm._arrays import array_of, mixed, text_bytes, tidy
from sparkwarden.llm._shared import stored

U = np.uint64
#: Bytes of text in a chunk, that a task holds at once; bytes of text for a range of phrases; ranges at least and at most, which are
#: parted further by a hash so that a part stands for so many bytes of text at most.
CHUNK, RANGE, FEWEST, MOST, PART = 8 << 20, 8 << 20, 64, 4096, 32 << 20
#: Bytes of sampled text for a range, to place the borders (which balance the load and change no result); nodes for each that is drawn.
SAMPLE, STRIDE = 256 << 10, 256
#: Pages of 32,768 bits of the filter of frequent pairs, at most (16 MB). A full filter sorts out less, and loses nothing.
PAGES, PAGE_BITS = 4096, 32768
#: The longest phrase in words.
DEPTH = 4
RUN = "lang string, part long, run binary"
NODE = "lang string, phrase string, f long"

_PIECE, _SPACE = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CLASS = bytes(2 if c in _PIECE else 1 if c in _SPACE else 0 for c in range(256))


class Words:
    """The words of some texts: `lang` and `word` as numbers in the order of `langs` and `vocabulary` (bytes), `piece` in which they stand."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        raw = b"\n".join(texts)
        kind = np.frombuffer(raw.translate(_CLASS), np.uint8)
        ink = np.zeros(len(kind) + 2, bool)
        ink[1:-1] = kind == 0
        starts, ends = np.flatnonzero(ink[1:-1] & ~ink[:-2]), np.flatnonzero(ink[1:-1] & ~ink[2:]) + 1
        bare = raw.translate(_LOWER, _PIECE + _SPACE)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(bare)]).dictionary_encode()
        order = np.asarray(pc.array_sort_indices(found.dictionary))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.vocabulary = found.dictionary.take(pa.array(order))
        self.word = rank[np.asarray(found.indices)] if len(starts) else np.zeros(0, np.int64)
        self.langs = sorted(set(langs))
        number = {x: k for k, x in enumerate(self.langs)}
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
        self.lang = np.array([number[x] for x in langs], np.int64)[np.searchsorted(begins, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
        self.piece = np.cumsum(kind == 2)[starts]
        self.size = max(len(order), 1)

    def follow(self, n: int) -> np.ndarray:
        """Whether the n words from each position on stand in one piece."""
        out = np.zeros(len(self.word), bool)
        if n <= len(self.word):
            out[: len(self.word) - n + 1] = self.piece[: len(self.word) - n + 1] == self.piece[n - 1 :]
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose pair stands in one piece, and the pairs as numbers (language, first and second word)."""
        at = np.flatnonzero(self.follow(2))
        return at, (self.lang[at] * self.size + self.word[at]) * self.size + self.word[at + 1]

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary.to_pylist()), U, len(self.vocabulary))


def _pair_slot(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A pair's bit in the filter, from hashes of its language and words."""
    return mixed(mixed(mixed(lang) ^ first, 1) ^ second, 2) % U(PAGES * PAGE_BITS)


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], U)


Nodes = tuple[np.ndarray, list[np.ndarray], np.ndarray]


def first_levels(w: Words) -> Nodes:
    """The nodes of words and pairs, sorted: languages, word numbers at each depth (-1: ends before), counts."""
    _, pair = w.pairs()
    v = w.size
    every = np.concatenate([(w.lang * v + w.word) * (v + 1), (pair // v) * (v + 1) + pair % v + 1])
    node, n = np.unique(every, return_counts=True)
    above = node // (v + 1)
    return above // v, [above % v, node % (v + 1) - 1], n


def deeper_levels(w: Words, bits: np.ndarray) -> Nodes:
    """The nodes of phrases of three and four words all of whose pairs the filter lets pass."""
    at, pair = w.pairs()
    v = w.size
    of, number = np.unique(pair, return_inverse=True)
    above = of // v
    h = w.hashes()
    slot = _pair_slot(_lang_hashes(w.langs)[above // v], h[above % v], h[of % v]) if len(of) else np.zeros(0, U)
    passes = (bits[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 == 1
    pair_at = np.full(len(w.word) + DEPTH, -1, np.int64)
    pair_at[at] = np.where(passes[number], number, -1) if len(at) else at
    three = np.flatnonzero((pair_at[:-1] >= 0) & (pair_at[1:] >= 0))
    triple, number, n3 = np.unique(pair_at[three] * v + w.word[three + 2], return_inverse=True, return_counts=True) if len(three) else (three, three, three)
    four = np.flatnonzero(pair_at[three + 2] >= 0)
    node, n4 = np.unique(number[four] * v + w.word[three[four] + 3], return_counts=True) if len(four) else (four, four)
    t = np.concatenate([np.arange(len(triple)), node // v])
    last = np.concatenate([np.full(len(triple), -1), node % v]).astype(np.int64)
    order = np.lexsort((last, t))
    t, last = t[order].astype(np.int64), last[order]
    p = triple[t] // v
    above = of[p] // v
    return above // v, [above % v, of[p] % v, triple[t] % v, last], np.concatenate([n3, n4])[order]


def _phrases(w: Words, depths: list[np.ndarray]) -> pa.Array:
    columns = [w.vocabulary.take(pa.array(d, mask=d < 0)) for d in depths]
    return pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()), null_handling="skip")


def _place(w: Words, border: list[bytes], n_depths: int) -> tuple[int, ...]:
    """A border in word numbers: nodes of its language are below it if their numbers are."""
    out = []
    for x in border[:n_depths]:
        k = bisect.bisect_left(_Look(w.vocabulary), x)
        out.append(k)
        if k == len(w.vocabulary) or w.vocabulary[k].as_py() != x:
            break  # the first node from here on is the border
    return tuple(out)


class _Look:
    """An Arrow array as a sequence of Python values."""

    def __init__(self, values: pa.Array):
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, k: int) -> bytes:
        return self.values[k].as_py()


def _cuts(w: Words, nodes: Nodes, lang: int, borders: list[list[bytes]]) -> np.ndarray:
    """Where the borders of a language lie among its sorted nodes: the first node that isn't below each."""
    langs, depths, _ = nodes
    lo, hi = np.searchsorted(langs, [lang, lang + 1])
    out = []
    for b in borders:
        i, j = lo, hi
        for number, d in zip(_place(w, b, len(depths)), depths):
            if i < j:
                i, j = i + np.searchsorted(d[i:j], [number, number + 1])
        out.append(i)
    return np.array([lo, *np.maximum.accumulate(np.array(out, np.int64)), hi] if out else [lo, hi], np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of chunks of rows (lang, text). A text beyond a chunk's size is cut between pieces; one piece stays whole."""
    texts, langs, held = [], [], 0
    for batch in batches:
        data, off = text_bytes(batch.column(1))
        own = data.tobytes() if batch.num_rows else b""
        for k, lang in enumerate(batch.column(0).to_pylist()):
            i, end = int(off[k]), int(off[k + 1])
            while i < end or i == int(off[k]):
                j = end
                if end - i > CHUNK:
                    cut = max(own.rfind(bytes([c]), i, i + CHUNK) for c in _PIECE)
                    after = min((x for c in _PIECE if (x := own.find(bytes([c]), i + CHUNK, end)) >= 0), default=end - 1) if cut < i else cut
                    j = after + 1
                texts.append(own[i:j])
                langs.append(lang)
                held += j - i + 1
                if held >= CHUNK:
                    yield Words(texts, langs)
                    texts, langs, held = [], [], 0
                if i == j:
                    break
                i = j
    if texts:
        yield Words(texts, langs)


def _serialised(phrases: pa.Array, n: np.ndarray) -> bytes:
    batch = pa.record_batch([phrases, pa.array(n, pa.int64())], names=["phrase", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _runs(levels: Callable[[Words], Nodes], borders, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each chunk's trie as sorted runs: lang, part (range and slice), run."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = borders.value
        for w in _texts(batches):
            nodes = levels(w)
            phrases = _phrases(w, nodes[1])
            for k, lang in enumerate(w.langs):
                cuts = _cuts(w, nodes, k, placed.get(lang, []))
                for r, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    own, n = phrases[i:j], nodes[2][i:j]
                    which = np.array([xxhash.xxh3_64_intdigest(p) % slices for p in own.to_pylist()]) if slices > 1 else None
                    for s in range(slices):
                        keep = own if which is None else own.filter(pa.array(which == s))
                        if len(keep):
                            blob = _serialised(keep, n if which is None else n[which == s])
                            yield pa.record_batch([pa.array([lang]), pa.array([r * slices + s], pa.int64()), pa.array([blob], pa.binary())], names=["lang", "part", "run"])

    return run


def _merge(least: int) -> Callable[[pa.Table], pa.Table]:
    """The runs of a part as one: nodes of `least` occurrences or more, in order, and how many words there are (phrase null)."""

    def merge(table: pa.Table) -> pa.Table:
        runs = pa.concat_tables(pa.ipc.open_stream(b).read_all() for b in table["run"].to_pylist())
        found = array_of(runs["phrase"].combine_chunks()).dictionary_encode()
        f = np.zeros(len(found.dictionary), np.int64)
        n = np.asarray(array_of(runs["n"].combine_chunks()))
        np.add.at(f, np.asarray(found.indices), n)
        words = np.asarray(pc.equal(pc.find_substring(found.dictionary, b" "), -1))
        keep = found.dictionary.filter(pa.array(f >= least))
        order = pc.array_sort_indices(keep)
        phrases = pa.concat_arrays([keep.take(order).cast(pa.string()), pa.array([None], pa.string())])
        counts = np.append(f[f >= least][np.asarray(order)], f[words].sum())
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(phrases), pa.string()), "phrase": phrases, "f": pa.array(counts, pa.int64())})

    return merge


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every STRIDE-th node of words and pairs of each chunk."""
    for w in _texts(batches):
        lang, depths, _ = first_levels(w)
        at = slice(STRIDE // 2, None, STRIDE)
        phrases = _phrases(w, [d[at] for d in depths])
        kept = [p[:64].decode("utf-8", "ignore") for p in phrases.to_pylist()]
        yield pa.record_batch([pa.array([w.langs[k] for k in lang[at].tolist()], pa.string()), pa.array(kept, pa.string()), pa.array([1] * len(kept), pa.int64())], names=["lang", "phrase", "f"])


def borders_of(rows: DataFrame, ranges: int, total: int, seed: int = 7) -> dict[str, list[list[bytes]]]:
    """Borders (as words) that cut each language's phrases into ranges of about equal load, from a sample of the texts."""
    part = rows.sample(min(1.0, ranges * SAMPLE / max(total, 1)), seed)
    per: dict[str, list[list[bytes]]] = {}
    for r in part.mapInArrow(tidy(_drawn), NODE).toLocalIterator():  # at most ranges * SAMPLE / STRIDE of them
        per.setdefault(r["lang"], []).append(r["phrase"].encode().split(b" "))
    every = sum(map(len, per.values()))
    out = {}
    for lang, found in per.items():
        found.sort()
        n = max(1, round(ranges * len(found) / every))
        out[lang] = [list(x) for x in sorted({tuple(found[k * len(found) // n]) for k in range(1, n)})]
    return out


def _frequent_pairs(pairs: DataFrame) -> np.ndarray:
    """The filter of frequent pairs as bytes, 16 MB whatever their number."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            two = [p.encode().split(b" ") for p in b.column(1).to_pylist()]
            h = [np.fromiter((xxhash.xxh3_64_intdigest(x[k]) for x in two), U, len(two)) for k in (0, 1)]
            slot = _pair_slot(_lang_hashes(b.column(0).to_pylist()), *h) if two else np.zeros(0, U)
            yield pa.record_batch([pa.array((slot // U(PAGE_BITS)).astype(np.int32)), pa.array((slot % U(PAGE_BITS)).astype(np.int64))], names=["page", "bit"])

    pages = pairs.select("lang", "phrase").mapInArrow(slots, "page int, bit long").groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    out = np.zeros(PAGES * PAGE_BITS // 8, np.uint8)
    for r in pages.collect():  # at most PAGES of 4 KB
        out[r["page"] * PAGE_BITS // 8 :][: PAGE_BITS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _words_in(phrase: Column) -> Column:
    return F.char_length(phrase) - F.char_length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def counted(df: DataFrame, text_col: str, lang_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to four words with `least` occurrences or more (lang, phrase, size, f), and each language's words (lang, n)."""
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ranges = min(MOST, max(FEWEST, total // RANGE))
    slices = max(1, -(-total // (ranges * PART)))
    borders = spark.sparkContext.broadcast(borders_of(rows, ranges, total))

    def merged(levels: Callable[[Words], Nodes], name: str) -> DataFrame:
        runs = rows.mapInArrow(_runs(levels, borders, slices), RUN)
        return stored(runs.groupBy("lang", "part").applyInArrow(_merge(least), NODE), name)

    first = merged(first_levels, "words-and-pairs")
    bits = spark.sparkContext.broadcast(_frequent_pairs(first.where("contains(phrase, ' ')")))
    deeper = merged(lambda w: deeper_levels(w, bits.value), "longer-phrases")
    n = first.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    for sent in (borders, bits):
        sent.unpersist()
    return first.unionByName(deeper).where("phrase is not null").withColumn("size", _words_in(F.col("phrase"))), n


def with_parts(nodes: DataFrame) -> DataFrame:
    """Phrases of two words or more with `left` and `right`: the counts of their first 1, 2, ... words and of the words that follow those."""
    first = F.expr("substring_index(phrase, ' ', size - 1)")
    last = F.expr("substring_index(phrase, ' ', 1 - size)")
    none = F.array().cast("array<bigint>")
    above = nodes.where("size = 1").select("lang", "phrase", "f", none.alias("left"), none.alias("right"))
    out = None
    for size in range(2, DEPTH + 1):
        own = nodes.where(F.col("size") == size).select("lang", "phrase", "f", first.alias("parent"), last.alias("link"))
        walk = above.select("lang", F.col("phrase").alias("parent"), F.concat("left", F.array("f")).alias("left"))
        links = above.select("lang", F.col("phrase").alias("link"), F.concat(F.array("f"), "right").alias("right"))
        above = own.join(walk, ["lang", "parent"]).join(links, ["lang", "link"]).select("lang", "phrase", "f", "left", "right")
        above = stored(above, f"phrases-of-{size}")
        out = above.withColumn("size", F.lit(size)) if out is None else out.unionByName(above.withColumn("size", F.lit(size)))
    return out


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, share: int = 80, scale: int = 2_000_000) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at [.,;:!?\\x0A-\\x0D] into pieces and those at spaces and tabs into words; null texts are empty,
    a null language is `und`. Phrases of two to four words with a >= least occurrences are rated at their weakest cut, by
    floor(scale * a / (l + r)) with the counts of the two parts, smallest cut first. Those of which a longer one holds `share` per cent
    or more of the occurrences are dropped. Order: score and a falling, phrase in byte order. Counts are of all rows, repeated ones too;
    an empty table gives an empty result. Only the two named columns are read.
    """
    nodes, n = counted(df, text_col, lang_col, least)
    phrases = with_parts(nodes)
    score = f"(cast(f as decimal(20, 0)) * {scale}) div (cast(left[k - 1] as decimal(20, 0)) + cast(right[k - 1] as decimal(20, 0)))"
    cut = F.expr(f"array_min(transform(sequence(1, size - 1), k -> struct({score} as score, k as k, left[k - 1] as l, right[k - 1] as r)))")
    rated = phrases.select("lang", "phrase", F.col("f").alias("a"), cut.alias("cut"))
    word = F.split("phrase", " ")
    spans = [(b, n) for n in range(2, DEPTH) for b in range(1, DEPTH - n + 2)]  # begin and length of a part
    inner = F.array(*[F.when(F.size(word) >= F.lit(max(b + n - 1, n + 1)), F.array_join(F.slice(word, b, n), " ")) for b, n in spans])
    longer = phrases.where("size > 2").select("lang", "f", F.explode(inner).alias("phrase")).where("phrase is not null").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = rated.join(longer, ["lang", "phrase"], "left").where(f"longest is null or cast(longest as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {share}")
    flat = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "salt"], ["lang"]):  # at most 64 * top of a language meet
        flat = flat.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return flat.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def brute_force(rows: list[tuple[str | None, str | None]], least: int = 30, top: int = 2000, share: int = 80) -> list[tuple]:
    """What collocations gives for rows of (lang, text), from plain counts of all phrases."""
    import collections
    import re

    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, DEPTH + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longest = collections.Counter()
        for p, a in candidates.items():
            for part in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}:
                longest[part] = max(longest[part], a)
        rated = []
        for p, a in candidates.items():
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if 100 * longest[p] < share * a:
                rated.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rated)[:top], 1)]
    return sorted(out)


ORACLE = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
split AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
gram AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM split, (VALUES (1), (2), (3), (4)) AS depth(k) WHERE len(w) >= k),
c AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 30),
cut AS (
  SELECT c.lang, c.phrase, c.k AS size, c.f, string_split(c.phrase, ' ') AS w, cuts.k FROM c, (VALUES (1), (2), (3)) AS cuts(k) WHERE cuts.k < c.k),
rated AS (
  SELECT cut.lang, cut.phrase, cut.f AS a, cut.k, l.f AS l, r.f AS r, CAST((CAST(cut.f AS HUGEINT) * 2000000) // (l.f + r.f) AS BIGINT) AS score
  FROM cut JOIN c l ON l.lang = cut.lang AND l.phrase = array_to_string(cut.w[1:cut.k], ' ') JOIN c r ON r.lang = cut.lang AND r.phrase = array_to_string(cut.w[cut.k + 1:], ' ')),
weakest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
span AS (
  SELECT lang, k AS size, f, string_split(phrase, ' ') AS w, s.b, s.n FROM c, (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) AS s(b, n) WHERE s.n < c.k AND s.b + s.n - 1 <= c.k),
longer AS (SELECT lang, array_to_string(w[b:b + n - 1], ' ') AS phrase, max(f) AS longest FROM span GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang)
WHERE longest IS NULL OR 100 * longest < 80 * a
QUALIFY rank <= 2000
"""
