"""Text functions against values worked out by hand."""

import re
import time

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions import text as T
from sparkwarden.functions.regex import any_of, java, keyed, literals, required
from sparkwarden.plans.catalog import RULES

CASES = [
    (T.normalize, [("Grüße  Straße", "grusse strasse"), ("kleinаnzeigen", "kleinanzeigen"), ("W​hatsApp", "whatsapp"), ("„Hi“ it’s", '"hi" its'), ("ﬁne", "fine"), (None, ""), ("Ａb \tc", "ab c"), ("x\ny", "x\ny")]),
    (T.squash, [("W h a t s A p p", "whatsapp"), ("wh@ts4pp 9", "whatsapp")]),
    (T.decode_entities, [("&amp;&auml;&#65;&#x41;&unk;&#x110000;&#128512;", "&äAA&unk;&#x110000;😀")]),
    (T.html_to_text, [('<p>Hi<br>there</p><a href="https://evil.shop/x">hier</a><script>x</script>', "Hi\nthere\nhier <https://evil.shop/x>"), ('<a href="https://a.de">https://a.de</a>', "https://a.de")]),
    (T.extract_urls, [("siehe https://www.Evil.shop/pay, und bit.ly/abc! mail a@gmail.com x", [("https://www.Evil.shop/pay", "evil.shop"), ("bit.ly/abc", "bit.ly")]), ("a.de A.DE", [("a.de", "a.de")]), ("x https://kleinanzeigen.de@evil.com/", [("https://kleinanzeigen.de@evil.com/", "evil.com")])]),
    (T.extract_phones, [("ruf 0171 1234567 an", ["0171 1234567"]), ("am 01.02.2024 DE89 3704 0044 0532 0130 00", []), ("+49171/2345678", ["+49171/2345678"])]),
    (T.extract_emails, [("Max (at) gmail (punkt) com oder A.B@X.de a.b@x.de", ["max@gmail.com", "a.b@x.de"])]),
    (T.redact_secrets, [("IBAN DE89 3704 0044 0532 0130 00", "IBAN [IBAN]"), ("Karte 4111 1111 1111 1111", "Karte [KARTENNUMMER]"), ("Karte 4111 1111 1111 1112", "Karte 4111 1111 1111 1112"), ("Passwort: geheim123!", "Passwort: [GEHEIM]!"), ("PIN 1234", "PIN [CODE]"), ("code1234", "code [CODE]")]),
    (lambda c: T.redact_pii(c, F.array(F.lit("Max Muster"))), [("Ich heiße Anna Lena. Wohne Hauptstraße 12, 10115 Berlin. Muster", "Ich heiße [NAME]. Wohne [ADRESSE], [PLZ] Berlin. [NAME]"), ("schreib an a@b.de oder https://x.shop/1, 0171 1234567 @max_m", "schreib an [E-MAIL] oder [LINK: x.shop] [TELEFONNUMMER] [BENUTZERNAME]"), ("VG\nKarl", "VG\n[NAME]")]),
    (lambda c: T.defang_urls(c, F.array(F.lit("ok.de"))), [("https://evil.com/a.b ok.de www.ok.de", "hxxps://evil[.]com/a[.]b ok.de www.ok.de")]),
    (lambda c: T.truncate(c, 10), [("kurz", "kurz"), ("abcdefghijk", "abcdefghi…"), ("abcdefgh ijklm", "abcdefgh…"), ("abcdefgh😀xyz", "abcdefgh…"), ("ab cdefghijkl", "ab cdefgh…")]),
    (T.parse_number, [("1.200,50 €", 1200.5), ("1,200.50", 1200.5), ("150,-", 150.0), ("ca 99,90", 99.9), ("x", None), ("1.5.2", 1.5)]),
    (lambda c: T.format_euro(c.cast("double")), [("1200.5", "1.200,50 €"), ("150", "150 €"), ("1234567", "1.234.567 €")]),
    (lambda c: T.any_unnegated(c, r"\bkurier"), [("ein kurier kommt", True), ("kein kurier", False), ("ohne den kurier", False), ("kein kurier aber kurier", True), ("nix", False)]),
    (T.host_of, [("https://www.A.de:80/x", "a.de"), ("http://a@b.com.", "b.com"), ("", "")]),
    (lambda c: T.redact_log(c, ["geheimnis1"]), [("x geheimnis1 y", "x *** y"), ("sk-or-abcdefghijkl", "sk-or-***")]),
]


@pytest.mark.parametrize("function,cases", CASES)
def test_text_function(spark, function, cases):
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "k int, t string")
    got = [r[1] for r in sorted(df.select("k", function(F.col("t"))).collect())]
    assert [[tuple(x) if hasattr(x, "asDict") else x for x in g] if isinstance(g, list) else g for g in got] == [want for _, want in cases]
from sparkwarden.plans.catalog import RULES


def test_redaction_changes_nothing_twice(spark):
    df = spark.createDataFrame([("IBAN DE89 3704 0044 0532 0130 00, PIN 1234, a@b.de, 0171 1234567",)], "t string")
    once = df.select(T.redact_pii(F.col("t")).alias("t"))
    assert once.first()[0] == once.select(T.redact_pii(F.col("t"))).first()[0]


def test_patterns():
    assert java("a$") == "a(?![\\s\\S])"
    assert literals(r"\b(mein|unser)\s+(fahrer|bote)\b") == frozenset({"mein", "unser"})
    assert literals(r"\b(cvv|cvc)2?\b") is None or all(len(x) >= 3 for x in literals(r"\b(cvv|cvc)2?\b"))


def test_required_literals_and_one_pattern_of_many():
    for r in RULES:
        for p in r.patterns:
            assert all(len(x) >= 3 for s in required(p) for x in s)
    assert set(required(r"\bwh?at+s?\s*-?\s*app\b")) == {frozenset({"what", "wat"}), frozenset({"app"})}
    assert required(r"(foo|bar)+baz?") == (frozenset({"foo", "bar"}),)
    assert required(r"[a-z]+\d{2,}") == ()
    words = {"tele", "telegram", "telefon", "a+b", "abc", "b", "cd", "de", "ef", "fg", "gh"}
    found = re.findall(f"(?=({any_of(words)}))", "xtelegramx telefo a+bc ghfg")
    assert found == ["telegram", "tele", "ef", "a+b", "b", "gh", "fg"]


def test_redaction_reads_long_runs_once(spark):
    """Texts on which the patterns went back and forth: some 10^10 steps, or a stack as deep as a name has parts."""
    runs = [("blanks", " " * 100_000), ("words", "a" * 100_000), ("hyphens", "a-" * 50_000), ("parts", "a." * 20_000), ("dashes", "-" * 100_000 + "a"), ("dots and words", "a.b-" * 20_000), ("digits", "0" * 100_000)]
    df = spark.createDataFrame([(k, f"x {t} y, max (at) gmail (punkt) com, @max_m, siehe https://evil.info/x oder 0171 1234567, PIN 4711") for k, t in runs], "k string, t string")
    began = time.monotonic()
    got = {r.k: r.r for r in df.select("k", T.redact_pii(F.col("t")).alias("r")).collect()}
    assert time.monotonic() - began < 60
    for k, t in runs:
        assert got[k] == f"x {t} y, [E-MAIL], [BENUTZERNAME], siehe [LINK: evil.info] oder [TELEFONNUMMER], PIN [CODE]", k


def test_redaction_where_matches_meet(spark):
    """Beginnings of matches that a look at the character before could miss."""
    cases = {
        "a (at) (at) b": "a@@b", "(at)": "@", "a@b.de%c@d.de": "[E-MAIL][E-MAIL]", "a at b dot cc-- at d dot ee": "[E-MAIL][E-MAIL]", "--- at x dot de": "--- at x dot de", "-a at x dot de": "[E-MAIL]",
        "x" * 70 + ".de": "x" * 70 + ".de", "." + "x" * 63 + ".de": "." + "x" * 63 + ".de", " " + "-" * 7 + "y" * 70 + ".de": " " + "-" * 7 + "y" * 70 + ".de", "(-foo.de)": "(-foo.de)", "foo.de. Und": "[LINK: foo.de]. Und", "foo.de.bar": "foo.de.bar", "xhttps://a.de/b": "xhttps://a.de/b",
        "(@max_m) @ab @abc": "([BENUTZERNAME]) @ab [BENUTZERNAME]", "é0171 1234567": "é[TELEFONNUMMER]", "a0171 1234567": "a0171 1234567", "++49 171 2345678": "+[TELEFONNUMMER]",
        "Kartenprüfziffer 123, PRÜFZIFFER: 123": "Kartenprüfziffer 123, PRÜFZIFFER: [CODE]", "PaſſWort: geheim": "PaſſWort: [GEHEIM]", "xPIN 1234 PIN1234": "xPIN 1234 PIN [CODE]", "exp. 12 / 2026": "exp. [DATUM]", "Steuer-ID 12 / 345 678 9": "Steuer-ID [STEUERNR]", "plz: 10115, geb. am 1. 2. 80": "plz: [PLZ], geb. am [GEBURTSDATUM]", "geb. 01.02.1980": "geb. [GEBURTSDATUM]",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = [r[1] for r in sorted(df.select("k", T.redact_pii(F.col("t"))).collect())]
    assert dict(zip(cases, got)) == cases


def test_keyed_patterns():
    assert keyed(r"\b(k?ab|sc)\d").startswith("(?=[AKSaks\u212a\u017f])")
    for pattern in (r"(ab)", r"\b(ä)", r"\b(a?)", r"\b[a-z]"):
        with pytest.raises(ValueError):
            keyed(pattern)
