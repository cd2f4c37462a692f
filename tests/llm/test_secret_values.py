"""Values after key words that token runs overlap."""

import random
import re

import numpy as np
import pytest

from sparkwarden.llm import secret_scan


@pytest.mark.parametrize("before", ["password = ", "password=", "see db_password: "])
def test_whole_value_is_redacted(spark, before):
    value = "hunter2!Xk29dkfjGHq83jfkLm"
    quote = "" if before.endswith("=") else '"'
    r = secret_scan.scan(spark.createDataFrame([(1, f"x {before}{quote}{value}{quote} y")], "doc_id long, text string")).first()
    assert "hunter2" not in r.redacted and "Xk29" not in r.redacted and len(r.secrets) == r.n_candidates == 1
    assert r.redacted.endswith(f"{secret_scan.MASK}{quote} y")


def test_runs_of_a_rejected_value_stay_candidates():
    text = b"token={a:fn(),k:1}/!?9b0b3c6a43eb78aa99cbd7049c572391524f37a8 z"
    found = secret_scan.candidates(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0, 1)
    assert any(text[a:b] == b"9b0b3c6a43eb78aa99cbd7049c572391524f37a8" for _, a, b in found)


def test_clashing_columns_and_many_secrets_in_a_long_text(spark):
    text = " ".join(f'é token = "{random.Random(k).getrandbits(160):040x}" und' for k in range(4000))
    df = spark.createDataFrame([(1, text, 7, "a", "b", "c"), (2, "é plain", 7, "a", "b", "c")], "doc_id long, text string, n_chars long, secrets string, redacted string, n_candidates string")
    got = {r.doc_id: r for r in secret_scan.redact(df).collect()}
    assert secret_scan.redact(df).columns == df.columns and got[1].secrets == "a" and got[2].text == "é plain" and got[2].n_chars == 7
    assert got[1].text.count(secret_scan.MASK) == 4000 and got[1].n_chars == len(got[1].text)
    spans = secret_scan.scan(df.select("doc_id", "text")).where("doc_id = 1").first()
    assert text[spans.secrets[3999].begin : spans.secrets[3999].end] == f"{random.Random(3999).getrandbits(160):040x}"


def test_findings_of_labelled_texts_train_a_forest(spark):
    """The corpus' own texts: what stands in quotes behind `token =` is a secret there, in any case; everything else is not."""
    pattern = re.compile(r'(?i)token = "([0-9a-f]{40})"')
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").where("text is not null").collect()]
    marked = [(t, pattern.findall(t)) for t in docs]
    assert sum(map(len, (x for _, x in marked))) > 20
    train, test = marked[::2], marked[1::2]
    rows = spark.createDataFrame(train, "text string, secret_values array<string>")
    findings = secret_scan.findings_of(rows)
    assert 0 < len(findings) <= secret_scan.TRAIN_ROWS and {y for *_, y in findings} == {0, 1}
    assert len(secret_scan.findings_of(rows, rows=5)) == 5
    got = secret_scan.scan(spark.createDataFrame(test, "text string, known array<string>"), forest=secret_scan.train(findings), text_col="text").collect()
    default = secret_scan.scan(spark.createDataFrame(test, "text string, known array<string>")).collect()
    for result in (got, default):
        want = sum(len(r.known) for r in result)
        found = sum(k not in r.redacted for r in result for k in r.known)
        wrong = sum(max(0, len(r.secrets) - len(r.known)) for r in result)
        assert found >= 0.95 * want and wrong <= 0.1 * want, (found, want, wrong)


def test_train_draws_from_all_findings():
    findings = secret_scan.labelled_findings(300, 5)
    assert secret_scan.train(findings, rows=100, seed=1).roots.shape == (secret_scan.TREES,)
    ordered = sorted(findings, key=lambda f: f[3])  # the first hundred are no secrets
    scores = secret_scan.train(ordered, rows=150).score(np.array([secret_scan.features(a, b, c) for a, b, c, _ in findings]))
    assert np.mean((scores >= 0.5) == np.array([y for *_, y in findings])) > 0.85
    with pytest.raises(ValueError):
        secret_scan.train([])
