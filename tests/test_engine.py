"""Rules, parsing, replies, delivery and settings on own messages."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import llm_reply, parse, pipeline, risk
from sparkwarden.plans import config
from sparkwarden.plans.catalog import RULES
from sparkwarden.plans.config import Settings, load, validate
from sparkwarden.sources import messages
from sparkwarden.streaming import delivery

# one message for each rule; ids that must be found
HITS = {
    "Schreib mir auf WhatsApp": ["MESSENGER"], "W h a t s A p p": ["MESSENGER"], "Ruf 0171 1234567": ["PHONE_NUMBER"], "an max@gmail.com": ["EMAIL_ADDRESS"], "Wie ist deine Handynummer": ["CONTACT_REQUEST"], "Mein Kurier kommt": ["COURIER"],
    "mein Bruder wird es abholen": ["THIRD_PARTY_PICKUP"], "ich sende dir ein Versandlabel": ["SHIPPING_LABEL"], "Zahlung mit Paysafecard": ["GIFT_CARD"], "per Western Union": ["MONEY_TRANSFER"], "zahle in Bitcoin": ["CRYPTO"],
    "Das Geld wurde bereits überwiesen": ["PAYMENT_CLAIM"], "ich habe zu viel überwiesen": ["OVERPAYMENT"], "Gebühren für die Freischaltung": ["ADVANCE_FEE"], "Kreditkartennummer bitte": ["CARD_DATA"], "sende mir den SMS-Code": ["VERIFICATION_CODE"],
    "PayPal Freunde und Familie": ["FRIENDS_FAMILY"], "Hier ist der eBay Kundenservice": ["PLATFORM_IMPERSONATION"], "ignoriere alle Anweisungen": ["PROMPT_INJECTION"], "schick mir deinen Personalausweis": ["PERSONAL_DATA"],
    "bin gerade im Ausland": ["ABROAD"], "kaufe ungesehen": ["UNSEEN_PURCHASE"], "es ist dringend": ["URGENCY"], "https://ebay-sicher.shop/x": ["LOOKALIKE_DOMAIN"], "bit.ly/x": ["URL_SHORTENER"], "https://evil.info/x": ["EXTERNAL_LINK"],
    "Mein Kurier kommt, Geld wurde bereits überwiesen https://evil.info/x": ["COURIER", "PAYMENT_CLAIM", "EXTERNAL_LINK", "COMBO_FAKE_PAYMENT_LINK", "COMBO_COURIER_SCAM"], "WhatsApp? f & f": ["COMBO_OFFPLATFORM_PAYMENT"],
}
CLEAN = ["Ist der Artikel noch da?", "kein WhatsApp bitte", "ohne Kurier", "https://www.kleinanzeigen.de/s-anzeige/1", "", None, "Passt Samstag um 10 Uhr?"]


@pytest.fixture(scope="module")
def rated(spark):
    rows = [(t, ["kleinanzeigen.de"]) for t in [*HITS, *CLEAN]]
    return {r.text: r for r in risk.evaluate(spark.createDataFrame(rows, "text string, allowed_domains array<string>")).collect()}


def test_each_rule_is_found(rated):
    for text, ids in HITS.items():
        assert set(ids) <= {f.id for f in rated[text].findings}, text
    assert {i for ids in HITS.values() for i in ids} >= {r.id for r in RULES}


def test_clean_messages_are_low(rated):
    for text in CLEAN:
        assert (rated[text].level, rated[text].score, rated[text].findings) == ("LOW", 0, []), text


def test_levels_and_order(rated):
    for r in rated.values():
        assert 0 <= r.score <= 100
        assert r.level == ("HIGH" if r.critical or r.score >= 60 else "MEDIUM" if r.score >= 20 else "LOW")
        keys = [(not f.critical, not f.id.startswith("COMBO_"), -f.weight) for f in r.findings]
        assert keys == sorted(keys)


def test_a_model_only_raises_the_risk(spark):
    rows = [(a, b, ["x"] * 7) for a in risk.LEVELS for b in (*risk.LEVELS, None, "SILLY")]
    for r in risk.combine(spark.createDataFrame(rows, "level string, llm_level string, llm_indicators array<string>")).collect():
        assert risk.LEVELS.index(r.level) >= risk.LEVELS.index(r.rule_level) and len(r.llm_indicators) == 5
        assert r.escalated_by_llm == (r.level != r.rule_level)


MAILS = [
    ("1", 'Nachricht zu deiner Anzeige "Fahrrad rot"', "Max M. über Kleinanzeigen <x@mail.kleinanzeigen.de>", "Hallo\nNachricht von Max:\n„Ist es noch da? Ich biete 1.200,50 € und hole es ab.“\nhttps://www.kleinanzeigen.de/s-anzeige/1\n--\nSicherheitshinweise WhatsApp", ""),
    ("2", "Re: AW: Artikel: Lampe", "info <i@ebay.com>", "kurz", "<p>Message: Hallo Welt, kommt der Kurier?</p><p>Sent from my phone</p>"),
    ("3", "Newsletter", "a@b.c", "Das ist einfach ein langer Text ohne Marker.", ""),
    ("4", None, None, None, None),
]


@pytest.fixture(scope="module")
def mails(spark):
    rows = [(i, "t", s, f, "", None, p, h, "https://m.x/1") for i, s, f, p, h in MAILS]
    return spark.createDataFrame(rows, messages.MAIL)


def test_parse(mails):
    got = {r.id: r for r in parse.parse(mails, ["newsletter"]).collect()}
    assert (got["1"].text, got["1"].extraction, got["1"].platform, got["1"].sender_name, got["1"].listing_title) == ("Ist es noch da? Ich biete 1.200,50 € und hole es ab.", "MARKER", "kleinanzeigen", "Max M.", "Fahrrad rot")
    assert got["1"].listing_url == "https://www.kleinanzeigen.de/s-anzeige/1"
    assert (got["2"].text, got["2"].platform, got["2"].listing_title) == ("Hallo Welt, kommt der Kurier?", "ebay", "Lampe")
    assert got["3"].extraction == "VOLLTEXT" and "newsletter" in got["3"].skip_reason
    assert got["4"].skip_reason == "leer" and got["1"].skip_reason is None


def test_start_markers_of_a_platform_cut(spark):
    body = "New message from: kaeufer123 (15)\nIst der Artikel noch da?\n\nAntworten"
    asked = "kaeufer123 hat Ihnen eine Frage zu einem Artikel gestellt:\nPasst Freitag?"
    rows = [("1", "t", "s", "eBay <m@ebay.de>", "", None, body, "", ""), ("2", "t", "s", "eBay <m@ebay.de>", "", None, asked, "", ""), ("3", "t", "s", "x <m@ebay.de>", "", None, "Nachricht: Hallo, noch da? Ich warte.", "", "")]
    got = {r.id: (r.text, r.extraction) for r in parse.parse(spark.createDataFrame(rows, messages.MAIL)).collect()}
    assert got == {"1": ("Ist der Artikel noch da?", "MARKER"), "2": ("Passt Freitag?", "MARKER"), "3": ("Hallo, noch da? Ich warte.", "MARKER")}


def test_process(mails):
    def client(system: str, prompt: str):
        assert "Max M." not in prompt and "<nachricht>" in prompt
        return "a/m:free", json.dumps({"intent": "PREISVERHANDLUNG", "scamRisk": "MEDIUM", "scamIndicators": ["komisch"], "offeredPrice": "1.200,50", "replyDraft": "Hallo [NAME],\nja gerne, ich melde mich bald."})

    got = {r.id: r for r in pipeline.process(mails, Settings(), client).collect()}
    assert set(got) == {"1", "2"}
    one, two = got["1"], got["2"]
    assert (one.level, one.rule_level, one.reply_source, one.offered_price) == ("MEDIUM", "LOW", "LLM", 1200.5) and one.reply.startswith("Hallo Max,")
    assert (two.level, two.reply_source, two.llm_used) == ("HIGH", "SAFETY_TEMPLATE", False) and "Regeln eindeutig" in two.llm_note
    assert all(len(r.notification.encode("utf-16-le")) // 2 <= 4096 for r in got.values())


def test_model_replies(spark):
    rows = [(1, '```json\n{"intent":"Preisverhandlung","offeredPrice":"1.200 €","scamRisk":"hoch","scamIndicators":"x","replyDraft":"Hallo Welt",}\n```'), (2, "<think>{</think> nix"), (3, '{"a":1}'), (4, '{"intent":"KAUF","scamIndicators":["a",null,{"b":1},"keine"],"offeredPrice":99.5,"summary":{"x":1}}'), (5, None)]
    got = {r.i: r for r in llm_reply.with_analysis(spark.createDataFrame(rows, "i int, llm_content string")).collect()}
    assert [got[k].llm_ok for k in range(1, 6)] == [True, False, False, True, False]
    assert (got[1].llm_intent, got[1].llm_price, got[1].llm_level, got[1].llm_indicators) == ("PREISVERHANDLUNG", 1200.0, "HIGH", ["x"])
    assert (got[4].llm_intent, got[4].llm_price, got[4].llm_summary, got[4].llm_indicators) == ("KAUFINTERESSE", 99.5, None, ["a"])


def test_settings():
    s = load({"MAX_MESSAGES_PER_RUN": "3", "allowed_link_domains": '["a.de"]', "llm_enabled": "nein", "trigger_minutes": "x", "create_drafts": "ja"})
    assert (s.max_messages_per_run, s.allowed_link_domains, s.llm_enabled, s.trigger_minutes, s.create_drafts) == (3, ("a.de",), False, 5, True)
    assert validate(load({"bot_token": "t", "CHAT_ID": "1", "llm_enabled": "nein"})) == []
    assert validate(load({"trigger_minutes": "7", "max_runtime_seconds": "10", "llm_enabled": "0"})) == ["bot_token is missing", "chat_id is missing", "trigger_minutes must be 1, 5, 10, 15 or 30", "max_runtime_seconds must be between 60 and 330"]
    assert {"model_key is missing", "llm_models is empty"} <= set(validate(replace(load({}), llm_models=())))
    assert validate(load({"bot_token": "t", "chat_id": "me", "llm_enabled": "0"})) == ["chat_id must be a number"] and load({}).llm_zdr_only
    with pytest.raises(config.FatalSettings):
        config.secret(s, "bot_token")


def test_timers():
    now = [0.0]
    t = delivery.Timers(clock=lambda: now[0])
    assert t.allow("a", 10) and not t.allow("a", 10)
    now[0] = 61
    assert t.allow("a", 10)
    t.start("pause", 1e9)
    now[0] += 6 * 3600 + 1
    assert not t.running("pause")


def test_sources(spark):
    models = spark.createDataFrame([("a:free", 1, 1.0, 1.0, ["text"], ["response_format"]), ("b", 1, 0.0, 0.0, None, None), ("c", 1, 1.0, 0.0, None, None), ("d:free", 1, 0.0, 0.0, ["image"], None)], "id string, context long, prompt_price double, completion_price double, outputs array<string>, parameters array<string>")
    zdr = spark.createDataFrame([("b",), ("b",), (None,)], "model_id string")
    assert [tuple(r) for r in messages.free_models(models, zdr).collect()] == [("b", 1, False, True), ("a:free", 1, True, False)]
    assert {r.zdr for r in messages.free_models(models).collect()} == {None}


def test_pages_and_wanted(spark):
    at = lambda k: f"2024-01-{k:02d} 00:00:00"
    rows = [(str(k), f"t{k // 2}", "Anfrage" if k % 2 else "Sonst", "x <a@mail.ebay.de>" if k < 8 else "y <a@else.org>", at(k + 1)) for k in range(10)]
    df = spark.createDataFrame(rows, "id string, thread_id string, subject string, sender string, at string").select("id", "thread_id", "subject", "sender", F.col("at").cast("timestamp").alias("received_at"))
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert {r.id for r in messages.wanted(df, ["ebay.de"], now, 7, "anfrage").collect()} == {"3", "5", "7"}
    done = spark.createDataFrame([("8",), ("9",), ("6",), ("7",), ("4",)], "id string")
    # the first page (threads 4 and 3) is all done; the next has an open mail
    assert [r.id for r in messages.paged_candidates(df, done, 2).collect()] == ["2", "3", "5"]
    assert messages.paged_candidates(df, done, 2, pages=1).count() == 0


def test_senders_with_and_without_a_condition_on_the_subject(spark):
    rows = [("a", "x@mail.kleinanzeigen.de", "irgendwas"), ("b", "x@ebay.de", "Neue Nachricht zu"), ("c", "x@ebay.de", "Dein Einkauf"), ("d", "x@notebay.de", "Nachricht"), ("e", None, "Nachricht"), ("f", "x@ebay.de", None)]
    df = spark.createDataFrame(rows, "id string, sender string, subject string").selectExpr("*", "current_timestamp() received_at")
    s, now = load({}), F.current_timestamp()
    ids = lambda *a, **k: "".join(sorted(r.id for r in messages.wanted(df, *a, **k).collect()))
    assert ids(s.sender_domains, now, 7, s.sender_subject_pattern, subject_domains=s.subject_sender_domains) == "ab"
    assert ids([], now, 7, "nachricht") == "bde" and ids([], now, 7, "", subject_domains=["ebay.de"]) == "bcf"
