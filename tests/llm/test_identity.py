"""Texts on which hashes that are polynomials modulo a power of two collide: Thue-Morse sequences of letters and of words."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkwarden.llm import _arrays, bpe, lm, ngram_join, packing, substring


def thue_morse(n, a, b, sep=""):
    return sep.join(b if k.bit_count() % 2 else a for k in range(n)), sep.join(a if k.bit_count() % 2 else b for k in range(n))


LETTERS = [t for n in (1024, 2048, 4096) for t in thue_morse(n, "x", "y")]
WORDS = [t for n in (1024, 2048, 4096) for t in thue_morse(n, "left", "right", " ")]
TEXTS = LETTERS + WORDS + ["a " + LETTERS[0], "a " + LETTERS[1], " ".join(LETTERS[:2]), " ".join(LETTERS[1::-1])]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def test_keys():
    data = [t.encode() for t in TEXTS] + [bytes(k) for k in range(70)] + [b"ab" * 4, b"ab" * 5, b"a", b"b"]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    keys = _arrays.span_keys(np.frombuffer(b"".join(data), np.uint8), offsets[:-1], offsets[1:])
    assert len({tuple(k) for k in keys.tolist()}) == len(data)
    twice = np.concatenate([keys, keys])
    twice[:, 0] = 7  # the second column decides
    found, where, which = _arrays.distinct_keys(twice)
    assert len(found) == len(data) and (twice[where][which] == twice).all()


def test_join_and_substrings(rows):
    docs = list(enumerate(TEXTS))
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.near_duplicates(rows).collect()} == ngram_join.brute_force(docs)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(rows).collect()} == substring.brute_force(docs)


def test_tokens(rows):
    got = {r.doc_id: r.decoded_sha256 for r in bpe.round_trip(rows, n_buckets=7).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(TEXTS)}
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: hf.encode(t, add_special_tokens=False).ids + [0] for k, t in enumerate(TEXTS)}
    for p in packing.pack(rows).collect():
        assert zlib.crc32(np.array(want[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32


def test_counts(rows):
    for r in lm.lm_scores(rows).collect():
        if len(TEXTS[r.doc_id].split()) == 1:
            assert r.n_known == (1 if r.held_out else 2)


@pytest.mark.parametrize("text", ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "  <|endoftext|>  b", "<|endoftext", "a<|endoftext|>'s <|endoftext|>\n\n", "", "é<|endoftext|>北 京<|endoftext|>"])
def test_added_tokens(text):
    hf, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(public_tokenizers.path(packing.RANKS), packing.TOKENIZER)
    data = [text.encode(), b"", ("q" + text).encode(), b"<|endof", b"text|>", b"plain 'll it's"]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    from sparkwarden.llm import _pretok

    buf, begin, first = _pretok.with_added(np.frombuffer(b"".join(data), np.uint8), offsets, 0, len(data), enc.added)
    for k, t in enumerate(data):
        words = [buf[begin[p] : begin[p + 1]].tobytes() for p in range(first[k], first[k + 1])]
        assert enc.encode(words)[0].tolist() == hf.encode(t.decode(), add_special_tokens=False).ids
