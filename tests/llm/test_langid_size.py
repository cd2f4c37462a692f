"""Language ID of short texts, and the memory of its vectors."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq

from sparkwarden.llm import langid


def _profile(texts):
    total = np.zeros(langid.DIMENSIONS)
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        total += langid.bundled(*np.unique(langid.grams(data, np.array([0, len(data)]), 0, 1)[0], return_counts=True))
    return total


def test_each_letter_has_a_vector_of_its_own():
    some = np.array([ord(c) for c in "aäáåçüöabcжшабвгдеёż"] + list(range(0x4E00, 0x5A00)))
    vectors = 1 - 2 * np.unpackbits(langid.letter_vectors(np.unique(some), 2), axis=1).astype(float)
    cosine = vectors @ vectors.T / langid.DIMENSIONS
    np.fill_diagonal(cosine, 0)
    assert np.abs(cosine).max() < 0.3 and abs(cosine.mean()) < 0.01
    # binding is the product of permuted vectors
    gram = np.array([(97 << 2 * langid.BITS) + (0x4E00 << langid.BITS) + 98])
    parts = [1 - 2 * np.unpackbits(langid.letter_vectors(np.array([c]), 2), axis=1)[0].astype(int) for c in (97, 0x4E00, 98)]
    assert (langid.gram_vectors(gram)[0] == np.roll(parts[0], 2) * np.roll(parts[1], 1) * parts[2]).all()


def test_profiles_equal_sums_of_single_grams():
    texts = ["Ein Text äöü", "", "北京 大学 x", "aaa aaa", "Ein"]
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    value, first = langid.grams(np.frombuffer("".join(texts).encode(), np.uint8), offsets, 0, len(texts))
    got = langid.profiles(value, first)
    for k, t in enumerate(texts):
        assert np.allclose(got[k], _profile([t]))


def test_short_texts_and_small_tables():
    rows = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist() if r["text"] and r["lang"]]
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
    names, rng, hits = sorted({r["lang"] for r in rows}), random.Random(1), []
    prototypes = np.array([_profile([r["text"] for r in rows if r["lang"] == n and not held(r)]) for n in names])
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    for r in filter(held, rows):
        for _ in range(4):
            at = rng.randint(0, max(0, len(r["text"]) - 20))
            hits.append(names[int((prototypes @ _profile([r["text"][at : at + 20]])).argmax())] == r["lang"])
    assert np.mean(hits) > 0.925
    assert langid.DIMENSIONS >= 512 and sum(v.nbytes for v in langid._tables.values()) < 5 << 20


def test_clashing_columns_and_long_texts(spark):
    rows = [(k, t, lang, 0.5, "x", "y", "z") for k, (t, lang) in enumerate([("das ist ein deutscher text " * 9000, "de"), ("this is an english text", "en"), ("this is it", "en"), ("das ist es", "de"), ("ein text", None), (None, "de")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, label string, held_out string")
    kept = langid.in_a_language(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4} and {r.lang_pred for r in kept.collect()} == {"x"}
    assert {r.doc_id: r.lang_pred for r in langid.language_id(df).collect()} | {4: "de"} == {0: "de", 1: "en", 2: "en", 3: "de", 4: "de", 5: "und"}
