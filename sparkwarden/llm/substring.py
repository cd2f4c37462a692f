"""Substring dedup: words covered by a window of 50 words that also starts in a document with a smaller id.

Windows with the same words share the least hash among their n-grams (their anchor), so documents are cut into runs of windows
with one anchor, and only anchors found in several documents lead on. Equal runs (by 128-bit digests) are merged before the
shuffle into one with its least and largest document. Runs meet in a shard by their anchor. A shard is an FM-index over its
distinct runs (Burrows-Wheeler transform in a wavelet matrix); each run is streamed through it by backward search, which extends
a match from a window's end to its start and gives up as soon as no smaller document holds it, once for the run's least document
and once for its other documents. The intervals of matched windows, and nothing else, go back to the documents.

An anchor found very often is cut further: its windows travel singly to shards chosen by their words, and are searched there in
the same way, so that no shard has to hold all runs of one anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm._arrays import array_of, chunks, distinct_keys, gram_hashes, run_digests, text_bytes, tidy, whole_groups, word_hashes, word_keys, words
from sparkwarden.llm._filters import join_groups, key_filter, maybe_in
from sparkwarden.llm._fm_index import ORDER, FMIndex
from sparkwarden.llm._shared import stored

WINDOW = 50
GRAM = 16
#: Documents with an anchor beyond which its windows are dealt singly; the runs of so many fit an index.
HOT = 20_000
#: Runs in an FM-index; a shard partition is cut into indexes of about this size, by route.
INDEX_RUNS = 16_384
NO_ID = np.iinfo(np.int64).max


def _runs(word: np.ndarray, firsts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: row, first and last window (by word within the row), anchor."""
    h, first = gram_hashes(word, firsts, gram)
    span = window - gram + 1
    least, k = h, 1
    while 2 * k <= span:
        least = np.minimum(least[:-k], least[k:]) if len(least) > k else least[:0]
        k *= 2
    if span > k:
        least = np.minimum(least[: k - span], least[span - k :]) if len(least) > span - k else least[:0]
    count = np.maximum(np.diff(firsts) - window + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    total = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(total[-1]) - total[row]
    anchor = least[at + first[row]]
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(row)) - 1 if len(begin) else begin
    return row[begin], at[begin], at[end], anchor[begin]


def _anchors(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids, hashes = (batch.column(c).to_numpy() for c in ("id", "h"))
            for i, j in chunks(offsets):
                buf, starts, ends, firsts = words(data, offsets, i, j)
                row, _, _, anchor = _runs(word_hashes(buf, starts, ends), firsts, window, gram)
                if len(row):
                    yield pa.RecordBatch.from_pydict({"anchor": anchor.view(np.int64), "id": ids[i + row], "h": hashes[i + row]})

    return run


PIECES = "route long, single boolean, digest binary, id long, h long, at int, n int, content string"


def _pieces(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs (or single windows) of shared anchors; their words are sent once for each distinct run and block."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids, hashes = (batch.column(c).to_numpy() for c in ("id", "h"))
            plain, hot = (array_of(batch.column(c)) for c in ("plain", "hot"))
            for i, j in chunks(offsets):
                buf, starts, ends, firsts = words(data, offsets, i, j)
                keys = word_keys(buf, starts, ends)
                row, a, b, anchor = _runs(keys[:, 0], firsts, window, gram)

                def among(lists: pa.Array) -> np.ndarray:
                    part = lists.slice(i, j - i)
                    own = np.repeat(np.arange(j - i), np.diff(part.offsets.to_numpy()))
                    listed = np.unique(np.rec.fromarrays([own, part.flatten().to_numpy().view(np.uint64)], names="row,anchor")) if len(own) else None
                    return np.zeros(len(row), bool) if listed is None else np.isin(np.rec.fromarrays([row, anchor], names="row,anchor"), listed)

                single = among(hot)
                keep = among(plain) & ~single
                count = (b - a + 1)[single]
                each = np.repeat(a[single] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if single.any() else np.zeros(0, np.int64)
                row2 = np.concatenate([row[keep], np.repeat(row[single], count)])
                if not len(row2):
                    continue
                at = np.concatenate([a[keep], each])
                n = np.concatenate([(b - a)[keep] + window, np.full(len(each), window)])
                w = firsts[row2] + at
                digests = run_digests(keys, w, w + n)
                number = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
                alone = np.arange(len(w)) >= keep.sum()
                route = np.where(alone, number[:, 0], np.concatenate([anchor[keep], np.zeros(int(alone.sum()), np.uint64)]))
                _, where, _ = distinct_keys(number)
                content = np.full(len(w), None, object)
                raw = buf.tobytes()
                x, y = starts[w[where]].tolist(), ends[w[where] + n[where] - 1].tolist()
                content[where] = [raw[p:q].decode() for p, q in zip(x, y)]
                yield pa.RecordBatch.from_pydict({
                    "route": route.view(np.int64), "single": alone, "digest": pa.array(digests, pa.binary()), "id": ids[i + row2], "h": hashes[i + row2],
                    "at": pa.array(at, pa.int32()), "n": pa.array(n, pa.int32()), "content": pa.array(content, pa.string()),
                })

    return run


def matched_windows(index: FMIndex, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sequence text[begin:begin+length], the intervals of words covered by windows that a smaller owner has too.

    Windows are tried from left to right. A window is matched from its end backwards; where the match ends, all windows over that
    place are skipped. After a match the window that adjoins it is tried, then, back from there, those between.
    """
    last = lengths - window
    live = np.flatnonzero(last >= 0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # of each live sequence: the window tried, the matched window before it, where to go on, and the state of the search
    q, t = live, np.zeros(len(live), np.int64)
    cur, resume, mode = np.full(len(q), -1), np.zeros(len(q), np.int64), np.zeros(len(q), np.int8)
    done, lo, hi = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), index.n)
    tested = np.zeros(window + 1, bool)  # lengths at which it is asked whether a smaller owner is among the matches
    tested[3::4] = tested[window] = True
    while len(q):
        symbol = text[begins[q] + t + (window - 1 - done)]
        lo, hi = index.step(symbol, lo, hi)
        done = done + 1
        fail = hi <= lo
        ask = np.flatnonzero(~fail & tested[done])
        if len(ask):
            fail[ask] = index.least_owner(lo[ask], hi[ask]) >= owner[q[ask]]
        match = ~fail & (done == window)
        stop = fail | match
        if not stop.any():
            continue
        if match.any():
            m = np.flatnonzero(match)
            begin = np.where(cur[m] >= 0, cur[m], t[m])
            out.append((q[m], begin, t[m] + window))
        # fail: windows up to the place where the match ended fail too
        past = t + (window - done) + 1
        scan, jump, back = mode == 0, mode == 1, mode == 2
        resume = np.where(match & scan, t + 1, np.where(fail & scan, past, np.where(fail & jump, past, resume)))
        new_t, new_mode, new_cur = t.copy(), mode.copy(), cur.copy()
        go = match & (scan | jump)  # try the window that adjoins this one
        new_cur[go] = t[go]
        new_t[go] = np.minimum(t[go] + window, last[q[go]])
        new_mode[go] = 1
        end = go & (t >= last[q])
        down = fail & (jump | back)
        new_t[down] = t[down] - 1
        new_mode[down] = 2
        rest = (fail & scan) | (match & back) | (down & (new_t <= cur))  # go on behind what is known
        new_t[rest], new_mode[rest], new_cur[rest] = resume[rest], 0, -1
        end |= rest & (new_t > last[q])
        t, mode, cur = new_t, new_mode, new_cur
        lo, hi, done = np.where(stop, 0, lo), np.where(stop, index.n, hi), np.where(stop, 0, done)
        if end.any():
            on = ~end
            q, t, mode, cur, resume, lo, hi, done = (x[on] for x in (q, t, mode, cur, resume, lo, hi, done))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


ANSWERS = "digest binary, least long, n_rows long, own array<struct<begin:int,end:int>>, others array<struct<begin:int,end:int>>"


def _shard(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each distinct run: the intervals of words to remove in its least document (own) and in all others."""

    def index_of(contents: pa.Array, least: np.ndarray, most: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        data, offsets = text_bytes(contents)
        buf, starts, ends, firsts = words(data, offsets, 0, len(contents))
        _, _, symbol = distinct_keys(word_keys(buf, starts, ends))
        size = int(symbol.max(initial=0)) + 2
        lengths = np.diff(firsts)
        begins = firsts[:-1] + np.arange(len(contents))
        text = np.zeros(len(symbol) + len(contents), np.int64)
        text[np.arange(len(symbol)) + np.repeat(np.arange(len(contents)), lengths)] = symbol + 1
        index = FMIndex(text, size, np.repeat(least, lengths + 1))
        several = np.flatnonzero(most > least)
        own = matched_windows(index, text, begins, lengths, least, window)
        others = matched_windows(index, text, begins[several], lengths[several], most[several], window)
        return [own, (several[others[0]], *others[1:])]

    def lists(n: int, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
        run, begin, end = found
        order = np.lexsort((begin, run))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(run, minlength=n))])
        pairs = pa.StructArray.from_arrays([pa.array(begin[order], pa.int32()), pa.array(end[order], pa.int32())], ["begin", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["route"], INDEX_RUNS):
            least, most = (table.column(c).to_numpy() for c in ("least", "most"))
            own, others = (lists(table.num_rows, x) for x in index_of(array_of(table.column("content")), least, most))
            some = pa.array((own.value_lengths().to_numpy() > 0) | (others.value_lengths().to_numpy() > 0))
            out = pa.table({"digest": table.column("digest"), "least": table.column("least"), "n_rows": table.column("n_rows"), "own": own, "others": others}).filter(some)
            yield from out.to_batches()

    return run


def _kept(columns: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """n_words, n_removed and kept text of each row; columns begin and end, where there are any, hold the row's intervals."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = batch.column("spans").to_pylist() if columns else [None] * len(texts)
            total, removed, kept = [], [], []
            for text, cut in zip(texts, spans):
                w = (text or "").encode().split()
                total.append(len(w))
                if cut:
                    gone = np.zeros(len(w) + 1, np.int64)
                    for s in cut:
                        gone[s["begin"]] += 1
                        gone[s["end"]] -= 1
                    stay = np.cumsum(gone)[:-1] == 0
                    removed.append(len(w) - int(stay.sum()))
                    w = [x for x, y in zip(w, stay.tolist()) if y]
                else:
                    removed.append(0)
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For rows (id, h, text): id, h and spans, the intervals (begin, end) of words to remove, where there are any; stored."""
    assert window < ORDER and gram <= window
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = stored(rows.mapInArrow(_anchors(window, gram), "anchor long, id long, h long"), "anchors")
    shared = stored(anchors.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("anchor", "n"), "shared-anchors")
    met = join_groups(anchors, shared, "anchor", "n", anchors.count())
    is_hot = F.col("n") > HOT
    lists = stored(met.groupBy("id", "h").agg(F.collect_set(F.when(~is_hot, F.col("anchor"))).alias("plain"), F.collect_set(F.when(is_hot, F.col("anchor"))).alias("hot")), "anchor-lists")
    some = maybe_in(rows, "id", key_filter(lists, "id")).where("_sw_maybe").drop("_sw_maybe")
    pieces = stored(some.join(lists, ["id", "h"]).select("id", "h", "text", "plain", "hot").mapInArrow(_pieces(window, gram), PIECES), "pieces")
    runs = pieces.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n_rows"), F.min("route").alias("route"), F.min("single").alias("single"), F.max("content").alias("content"))
    # a single window of one document has no partner, as all windows of its words meet in it
    open_ = runs.where("not single or least < most").drop("single")
    answers = stored(open_.repartition(n, "route").sortWithinPartitions("route").mapInArrow(_shard(window), ANSWERS), "answers")
    found = join_groups(pieces.select("digest", "id", "h", "at"), answers, "digest", "n_rows", pieces.count())
    spans = found.select("id", "h", "at", F.explode(F.when(F.col("id") == F.col("least"), F.col("own")).otherwise(F.col("others"))).alias("s"))
    spans = spans.select("id", "h", F.struct((F.col("at") + F.col("s.begin")).alias("begin"), (F.col("at") + F.col("s.end")).alias("end")).alias("span"))
    return stored(spans.groupBy("id", "h").agg(F.collect_set("span").alias("spans")), "spans")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by a space) of each row of df.

    Words are runs without [\\x20\\x09-\\x0D]; a null or empty text has none, and texts under `window` words lose nothing. Rows
    with the same id never remove words from each other; a null id counts as larger than all others. Ids are integers. An empty
    table gives an empty result.
    """
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    spans = repeated_spans(rows, window, gram)
    marked = maybe_in(rows, "id", key_filter(spans, "id"))
    schema = "id long, n_words long, n_removed long, kept string"
    free = marked.where("not _sw_maybe").select("id", "text").mapInArrow(_kept(False), schema)
    cut = marked.where("_sw_maybe").drop("_sw_maybe").join(spans, ["id", "h"], "left").select("id", "text", "spans").mapInArrow(_kept(True), schema)
    return free.unionByName(cut).select(F.when(F.col("id") != int(NO_ID), F.col("id")).alias(id_col), "n_words", "n_removed", "kept")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return substring_dedup(df, id_col, text_col).select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by a dictionary of all windows, for small tables with distinct ids."""
    least: dict[tuple[bytes, ...], int] = {}
    split = {k: (t or "").encode().split() for k, t in docs}
    for k, w in split.items():
        for p in range(len(w) - window + 1):
            x = tuple(w[p : p + window])
            least[x] = min(least.get(x, k), k)
    out = {}
    for k, w in split.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < k:
                gone[p : p + window] = [True] * window
        kept = [x for x, y in zip(w, gone) if not y]
        out[k] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
