"""Operators against brute-force versions, exact round trips and held-out accuracy, with nulls, empties, ties and repeated rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sparkwarden.llm import ann, bpe, exact_dedup, langid, lm, ngram_join, packing, secret_scan, substring, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, keep_id string, id string"
LONG = " ".join(f"w{k % 977}" for k in range(20000))
ODD = [(1, None, "en", "x", "y"), (2, "", None, "x", "y"), (3, "  \n\t ", "en", None, None), (4, "a", "en", "x", "y"), (4, "a", "en", "x", "y"), (5, "a b\tc", "en", "x", "y"), (6, "abc", "en", "x", "y"), (None, "abc ", "de", "x", "y"), (7, LONG, "de", "x", "y"), (8, LONG + " z", "de", "x", "y"), (9, "it's  'quoted' — 北京 １２ <|endoftext|>\n\n x", "fr", "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(3)


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


def test_ngram_join(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.near_duplicates(documents).collect()}
    assert got == ngram_join.brute_force(docs)


def test_ngram_join_large_group(spark, monkeypatch):
    rng, rows = random.Random(5), []
    base = [[f"w{rng.randint(0, 300)}" for _ in range(150)] for _ in range(3)]
    for k in range(90):
        words = list(base[k % 3])
        for _ in range(rng.randint(0, 5)):
            words[rng.randint(0, 149)] = f"x{rng.randint(0, 9)}"
        rows.append((k * 3, " ".join(words) if k % 23 else rng.choice([None, "", "a b", "a b c d e"])))
    monkeypatch.setattr(ngram_join, "LIMIT", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.near_duplicates(df).collect()} == ngram_join.brute_force(rows)
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_ngram_join_odd_rows(odd):
    got = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(odd).collect()}
    assert {(1, 1, 0), (2, 2, 0), (3, 3, 0), (7, 7, 1), (8, 7, 1), (None, 6, 0)} <= got
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and 8 not in {r.doc_id for r in kept.collect()}


def _encoding(name):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(odd, documents):
    enc = _encoding("byte_bpe_multi_50k.tiktoken")
    for df in (odd, documents):
        want = collections.Counter()
        for r in df.collect():
            ids = enc.encode_ordinary(r.text or "")
            want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
        assert collections.Counter(map(tuple, bpe.round_trip(df).collect())) == want
    back = bpe.decode(bpe.encode(odd.where("doc_id in (1, 2, 5, 9)")))
    assert {r.doc_id: bytes(r.bytes or b"").decode() for r in back.collect()} == {k: t or "" for k, t, *_ in ODD if k in (1, 2, 5, 9)}
    assert bpe.round_trip(odd.limit(0)).count() == 0


def test_packing(odd):
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: hf.encode(t or "", add_special_tokens=False).ids + [0] for k, t, *_ in ODD}
    pieces = packing.pack(odd).collect()
    assert sum(p.length for p in pieces) == sum(len(want[k]) for k, *_ in ODD)
    for p in pieces:
        ids = want[p.doc_id]
        assert p.doc_tokens == len(ids) and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for k, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or k == max(by_sequence)
    assert {r.sequence_id: len(r.ids) for r in packing.sequences(odd).collect()} == {k: sum(x for _, x in v) for k, v in by_sequence.items()}
    assert packing.pack(odd.limit(0)).count() == 0


def test_substring(spark, documents, monkeypatch):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(documents).collect()}
    assert got == substring.brute_force(docs)
    rng, rows = random.Random(5), []
    base = [[rng.choice("abc") for _ in range(200)] for _ in range(3)]
    for k in range(40):
        words = []
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, 150)
            words += rng.choice(base)[i : i + rng.randint(1, 120)]
        if k % 7 == 0:
            words += ["z"] * rng.randint(1, 200)
        rows.append((k * 3, " ".join(words) if k % 11 else None))
    want = substring.brute_force(rows)
    for hot in (5, 20_000):
        monkeypatch.setattr(substring, "HOT", hot)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(df).collect()} == want
    assert substring.digests(df.limit(0)).count() == 0


def test_substring_odd_rows(odd):
    got = {r.doc_id: r.n_removed for r in substring.digests(odd).collect()}
    assert got[7] == 0 and got[8] == 20000 and got[None] == 0


def test_secret_scan(spark):
    forest = secret_scan.train()
    held = secret_scan.labelled_findings(1500, 99)
    scores = forest.score(np.array([secret_scan.features(a, b, c) for a, b, c, _ in held]))
    assert np.mean((scores >= 0.5) == np.array([y for *_, y in held])) > 0.97
    secret = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    rows = [(1, f'é token = "{secret}" x', 5), (2, f"commit {secret}", 6), (3, None, None), (4, "", 0), (5, "nothing here", 12), (5, "nothing here", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in secret_scan.scan(df).collect()}
    assert [(s.begin, s.end) for s in got[1].secrets] == [(11, 51)] and got[1].redacted == 'é token = "[SECRET]" x'
    assert all(not got[k].secrets for k in (2, 3, 4, 5)) and got[3].redacted is None
    fixed = {(r.doc_id, r.text, r.n_chars) for r in secret_scan.redact(df).collect()}
    assert (1, 'é token = "[SECRET]" x', 22) in fixed and (3, None, None) in fixed and secret_scan.redact(df).columns == df.columns
    assert secret_scan.findings(df.limit(0)).count() == 0


def test_language_id(spark, odd):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in df.collect()}
    got = langid.language_id(df).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd_got = [(r.doc_id, r.lang_pred) for r in langid.language_id(odd).collect()]
    assert {k for k, p in odd_got if p == "und"} == {1, 2, 3} and len(odd_got) == len(ODD)
    assert langid.in_a_language(odd).columns == odd.columns and langid.language_id(odd.limit(0)).count() == 0


def test_exact_dedup(odd):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect())
    assert got[(1, 3, 3, False)] and got[(2, 3, 3, False)] and got[(3, 3, 3, True)]
    assert got[(4, 4, 2, True)] == got[(4, 4, 2, False)] == 1
    assert got[(5, 5, 3, True)] and got[(6, 5, 3, False)] and got[(None, 5, 3, False)]
    kept = exact_dedup.survivors(odd)
    assert kept.columns == odd.columns and collections.Counter(r.doc_id for r in kept.collect()) == {3: 1, 4: 1, 5: 1, 7: 1, 8: 1, 9: 1}
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 200)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    v = [1.0, 2.0, 3.0]
    odd = [(k, v) for k in range(120)] + [(200, None), (250, [0.0, 0.0, 0.0]), (300, [1.0, None, 2.0]), (350, [float("nan"), 1.0, 1.0]), (None, v)] + [(400 + k, [1.0, float(k), 2.0]) for k in range(30)]
    for data in (rows, odd, odd[:3]):
        df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
        want, got = ann.brute_force(data), collections.defaultdict(list)
        for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
            got[r.query_id].append((r.vec_id, r.score))
        assert {k: len(x) for k, x in want.items() if x} == {k: len(x) for k, x in got.items()}
        hits = sum(len({a for a, _ in got[k]} & {a for a, _ in x}) for k, x in want.items())
        assert hits >= 0.9 * sum(map(len, want.values()))
        for k, x in got.items():
            exact = dict(want[k])
            assert all(abs(exact[a] - s) < 1e-12 for a, s in x if a in exact) and [s for _, s in x] == sorted((s for _, s in x), reverse=True)
    assert ann.nearest(df.limit(0)).count() == 0


def test_warc(spark):
    big = "x" * 2000
    rows = [(1, None, None), (2, "u", big), (3, None, big), (None, "é", big), (None, None, "y" * 1500), (5, "u", "ab"), (6, "u", "ab")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = {(1, 0, sha(""), "response", None), (2, 2000, sha(big), "revisit", 3), (3, 2000, sha(big), "response", None), (None, 2000, sha(big), "revisit", 3), (None, 1500, sha("y" * 1500), "response", None), (5, 2, sha("ab"), "response", None), (6, 2, sha("ab"), "response", None)}
    assert {tuple(r) for r in warc.round_trip(df).collect()} == want
    assert warc.round_trip(df.limit(0)).count() == 0
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    path = warc.write_archives(pages.coalesce(1)).first()[0].removeprefix("file:")
    with open(path, "rb") as f:
        data = f.read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME and len(list(warc.read_archive(data))) == 250
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(data[:-3]))


def test_lm(documents, texts):
    low = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    tokens = {k: re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)) + ["\0end"] for k, t in texts.items()}
    count = collections.Counter()
    for k, x in tokens.items():
        if zlib.crc32(str(k).encode()) % 10:
            count.update(x)
    n, v = sum(count.values()), len(count)
    got = lm.lm_scores(documents).collect()
    assert len(got) == len(texts)
    for r in got:
        x = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(x), sum(w in count for w in x), n, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        assert abs(base - r.base_score) < 1e-6 * abs(base)


def test_lm_beats_unigrams_on_held_out_texts(spark, odd):
    got = lm.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.lm_scores(odd).count() == len(ODD) and lm.lm_scores(odd.limit(0)).count() == 0
