"""Registered queries about sources, parsing, a model's answers and replies, over the driver's tables, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import text as T
from sparkwarden.operators import heuristics, llm_reply, notify, parse, reply, risk
from sparkwarden.plans.config import Settings
from sparkwarden.plans.phrases import DU, LABELS
from sparkwarden.queries import _WHITE, SQL_NORM, SQL_SAID, SQL_TURN_NORMS, SQL_TURNS, _per_document, _q, _sql_free, _table, _turns, query
from sparkwarden.sources import messages


def _pick(values: list[str], key: str) -> Column:
    """The value of a key's number, in turn."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def _sql_pick(values: list[str | None], key: str) -> str:
    return "[" + ", ".join("NULL" if v is None else _q(v) for v in values) + f"][({key} % {len(values)}) + 1]"


# --------------------------------------------------------------------------------------------- sources


@query("q_latest", "SELECT event_id, ts FROM events WHERE ts IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.latest(_table(spark, sf_dir, "events"), "event_id", "ts").select("event_id", "ts")


@query("q_paged_candidates", """
WITH t AS (SELECT user_id, max(ts) AS m FROM events GROUP BY user_id ORDER BY m DESC, user_id DESC LIMIT 15),
r AS (SELECT user_id, (row_number() OVER (ORDER BY m DESC, user_id DESC) - 1) // 5 AS p FROM t),
o AS (SELECT event_id, user_id, p FROM events JOIN r USING (user_id) WHERE event_type = 'error' AND event_id % 7 = 3)
SELECT event_id, user_id FROM o WHERE p = (SELECT min(p) FROM o)""")
def paged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as threads; all but some errors are done."""
    events = _table(spark, sf_dir, "events")
    done = events.where("event_type != 'error' or event_id % 7 != 3")
    return messages.paged_candidates(events, done, 5, 3, "user_id", "event_id", "ts").select("event_id", "user_id")


@query("q_thread_explode", "SELECT conv_id, turn, CAST(i AS INTEGER) AS i, w[i] AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM conversations WHERE text IS NOT NULL)")
def thread_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a thread whose messages are its words."""
    words = F.transform(F.split("text", " "), lambda w, k: F.struct((k + 1).alias("i"), w.alias("word")))
    threads = _table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("thread_id"), words.alias("messages"))
    parts = F.split("thread_id", "-")
    return messages.explode_threads(threads).select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"), F.col("i").cast("int").alias("i"), "word")


@query("q_to_input", f"""
SELECT doc_id, length(plain) AS n_plain, md5(CASE WHEN length(regexp_replace(plain, {_q('^' + _WHITE + '+|' + _WHITE + '+$')}, '', 'g')) < 20 THEN coalesce(text, '') ELSE '' END) AS html_md5, reply_to
FROM (SELECT doc_id, text, left(coalesce(text, ''), doc_id % 40) AS plain, coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, '') AS reply_to FROM documents)""")
def to_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mails whose plain body is a beginning of the text, and whose HTML is the text."""
    docs = _table(spark, sf_dir, "documents")
    empty = F.lit(None).cast("string")
    mails = docs.select("doc_id", empty.alias("subject"), empty.alias("sender"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("reply_to"), F.expr("left(text, doc_id % 40)").alias("plain_body"), F.col("text").alias("html_body"), empty.alias("permalink"))
    return messages.to_input(mails).select("doc_id", F.char_length("plain_body").cast("long").alias("n_plain"), F.md5("html_body").alias("html_md5"), "reply_to")


@query("q_chats", "SELECT user_id AS chat_id, arg_max(left(event_type, 1) || event_id, event_id) AS title FROM events WHERE event_type IN ('view', 'click', 'purchase') AND user_id IS NOT NULL GROUP BY user_id")
def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as updates of a bot; errors have no chat."""
    chat = F.struct(F.col("user_id").alias("chat_id"), F.concat(F.left("event_type", F.lit(1)), F.col("event_id").cast("string")).alias("title"))
    kinds = {"message": "view", "channel_post": "click", "edited_message": "purchase", "my_chat_member": "none"}
    return messages.chats(_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), *[F.when(F.col("event_type") == v, chat).alias(k) for k, v in kinds.items()]))


@query("q_free_models", """
SELECT id, context, json_mode, zdr FROM (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey || ':free' ELSE CAST(p_partkey AS VARCHAR) END AS id, CAST(p_size AS BIGINT) AS context, p_partkey % 2 = 0 AS json_mode, p_partkey % 3 = 0 AND p_size > 25 AS zdr,
         p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS free, p_partkey % 4 != 1 AS text FROM part)
WHERE free AND text""")
def free_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as models: some free by name, some by price; one kind of four writes no text; large free ones store nothing."""
    part, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(":free"))).otherwise(k.cast("string"))
    price = F.when(k % 5 == 0, 0.0).otherwise(F.col("p_retailprice").cast("double"))
    outputs = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.array(F.lit("image"))).otherwise(F.array(F.lit("image"), F.lit("text")))
    models = part.select(name.alias("id"), F.col("p_size").cast("long").alias("context"), price.alias("prompt_price"), price.alias("completion_price"), outputs.alias("outputs"), F.array(F.lit("x"), F.when(k % 2 == 0, "response_format").otherwise("y")).alias("parameters"))
    zdr = part.where("p_size > 25").select(F.concat(k.cast("string"), F.lit(":free")).alias("model_id"))
    return messages.free_models(models, zdr).select("id", "context", "json_mode", "zdr")


# --------------------------------------------------------------------------------------------- text functions

_OBFUSCATED = " max.m (at) mail [dot] de, eva ät web punkt at"
_per_document("q_count_digits", f"SELECT doc_id, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS INTEGER) AS n FROM {SQL_SAID}", said=True, n=lambda: T.count_digits(F.col("text")))
_per_document("q_deobfuscate_emails", f"SELECT doc_id, md5(text || ' max.m@mail.de, eva@web.at') AS text_md5 FROM {SQL_SAID}", said=True, text_md5=lambda: F.md5(T.deobfuscate_emails(F.concat("text", F.lit(_OBFUSCATED)))))
_per_document("q_extract_ibans", "SELECT doc_id, 'DE' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || ' 3704 0044 0532 0130 00' AS ibans FROM documents", ibans=lambda: F.array_join(T.extract_ibans(F.concat(F.coalesce("text", F.lit("")), F.lit(". IBAN: DE"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(" 3704 0044 0532 0130 00, danke"))), "|"))
_per_document("q_short_model", "SELECT p_partkey, p_name AS model FROM part", "part", "p_partkey", model=lambda: T.short_model(F.concat(F.lit("maker/"), "p_name", F.lit(":free"))))
_per_document("q_redact_log", "SELECT doc_id, coalesce(text, '') || ' bot*** and sk-or-*** and ***' AS line FROM documents", line=lambda: T.redact_log(F.concat(F.coalesce("text", F.lit("")), F.lit(" bot123456:abcdefghijklmnopqrstuvw and sk-or-abcdefghijkl and "), F.lit("topsecret")), ["topsecret", "no"]))


@query("q_listing_title", "SELECT p_partkey, p_name AS title FROM part")
def listing_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in subjects of four shapes."""
    shapes = [("Re: AW: Anfrage zu „", "“"), ('wg : Nachricht zu "', '" erhalten'), ("Fwd: Deine Anzeige: ", ""), ("Frage zum Artikel - ", "")]
    at = lambda k: _pick([s[k] for s in shapes], "p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", parse.listing_title(F.concat(at(0), "p_name", at(1))).alias("title"))


@query("q_sender_name", "SELECT c_custkey, c_name AS name FROM customer")
def sender_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names as display names, or only in the body."""
    name, k = F.col("c_name"), F.col("c_custkey")
    sender = F.when(k % 3 == 0, F.concat(F.lit('"'), name, F.lit(' über Kleinanzeigen" <x@mail.kleinanzeigen.de>'))).when(k % 3 == 1, F.concat(name, F.lit(" <a@b.de>"))).otherwise("noreply@kleinanzeigen.de")
    body = F.concat(F.lit("Hallo,\nNachricht von "), F.when(k % 3 == 2, name).otherwise("Jemand"), F.lit("\nText"))
    return _table(spark, sf_dir, "customer").select("c_custkey", parse.sender_name(sender, body).alias("name"))


# --------------------------------------------------------------------------------------------- a model's answers, replies

_INTENTS = {"Preis-Verhandlung": "PREISVERHANDLUNG", "verfügbar?": "VERFUEGBARKEIT", "TERMINABSPRACHE": "TERMINABSPRACHE", "eine Frage": "FRAGE_ZUM_ARTIKEL", "will kaufen": "KAUFINTERESSE", "Gruß": "SONSTIGES", "frage zum artikel": "FRAGE_ZUM_ARTIKEL"}
_WAYS = {"abholung": "ABHOLUNG", "pickup or shipping": "BEIDES", "Versand": "VERSAND", "beides": "BEIDES", "egal": "UNKLAR"}
_RISKS = {"Hoch": "HIGH", "mittel": "MEDIUM", "LOW": "LOW", "vielleicht": None}
_NOTHING = {"bar": "bar", "keine": None, "n/a": None, " PayPal ": "PayPal"}


@query("q_llm_fields", f"""
SELECT o_orderkey, o_orderkey % 9 != 8 AS ok, CASE WHEN o_orderkey % 9 != 8 THEN {_sql_pick(list(_INTENTS.values()), 'o_orderkey')} END AS intent, CASE WHEN o_orderkey % 9 != 8 AND o_totalprice > 0 AND o_totalprice < 1000000 THEN CAST(o_totalprice AS DOUBLE) END AS price,
       CASE WHEN o_orderkey % 9 != 8 THEN {_sql_pick(list(_WAYS.values()), 'o_orderkey')} END AS logistics, CASE WHEN o_orderkey % 9 != 8 THEN {_sql_pick(list(_RISKS.values()), 'o_orderkey')} END AS level,
       CASE WHEN o_orderkey % 9 != 8 THEN {_sql_pick(list(_NOTHING.values()), 'o_orderkey')} END AS payment, CASE WHEN o_orderkey % 9 != 8 THEN CASE WHEN o_orderkey % 4 = 3 THEN 'eins' ELSE 'a|b|c|d|e' END END AS indicators
FROM orders""")
def llm_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers of a model: thoughts and fences around, a comma too many, numbers as texts, German words; some aren't JSON."""
    number = F.format_number(F.col("o_totalprice").cast("double"), 2)
    price = F.when(F.col("o_orderkey") % 2 == 0, F.replace(number, F.lit(","), F.lit(""))).otherwise(F.concat(F.lit('"'), F.translate(number, ",.", ".,"), F.lit(' €"')))
    signs = F.when(F.col("o_orderkey") % 4 == 3, F.lit('"eins"')).otherwise('["a", "", "b", "keine", "c", "d", "e", "f"]')
    k = "o_orderkey"
    good = F.concat(
        F.lit('<think>{"x"}</think> ```json\n{"intent": "'), _pick(list(_INTENTS), k), F.lit('", "offeredPrice": '), price, F.lit(', "logistics": "'), _pick(list(_WAYS), k), F.lit('", "scamRisk": "'), _pick(list(_RISKS), k),
        F.lit('", "paymentMethod": "'), _pick(list(_NOTHING), k), F.lit('", "scamIndicators": '), signs, F.lit(',}\n``` '),
    )
    rows = _table(spark, sf_dir, "orders").select(k, F.when(F.col(k) % 9 == 8, F.lit("no JSON {at all}")).otherwise(good).alias("llm_content"))
    out = llm_reply.with_analysis(rows)
    return out.select(k, F.col("llm_ok").alias("ok"), F.col("llm_intent").alias("intent"), F.col("llm_price").alias("price"), F.col("llm_logistics").alias("logistics"), F.col("llm_level").alias("level"), F.col("llm_payment").alias("payment"), F.array_join("llm_indicators", "|").alias("indicators"))


def _sql_template() -> str:
    """The reply to an order about a part: what is thanked for, available, offered, the way; or a promise."""
    euro = "regexp_replace(replace(replace(replace(format('{:,.2f}', CAST(p_retailprice AS DOUBLE)), ',', 'x'), '.', ','), 'x', '.'), ',00$', '') || ' €'"
    filled = lambda s, **v: " || ".join(v[p] if i % 2 else _q(p) for i, p in enumerate(re.split(r"\{(\w+)\}", s)) if p)
    thanks = filled(DU.thanks_for, title="p_name")
    there = f"CASE WHEN p_partkey % 7 IN (1, 2, 4) THEN {_q(DU.available)} END"
    offer = f"CASE WHEN p_partkey % 2 = 0 THEN {filled(DU.offer, price=euro)} END"
    way = f"CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN {_q(DU.pickup)} WHEN p_partkey % 5 = 2 THEN {_q(DU.shipping)} END"
    return f"'Hallo Eva,' || chr(10) || chr(10) || concat_ws(' ', {thanks}, {there}, {offer}, {way}, CASE WHEN {there} IS NULL AND {offer} IS NULL AND {way} IS NULL THEN {_q(DU.later)} END) || chr(10) || chr(10) || 'Viele Grüße'"


@query("q_reply_template", f"SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'SAFETY_TEMPLATE' ELSE 'TEMPLATE' END AS source, CASE WHEN p_partkey % 11 = 0 THEN 'Hallo Eva,' || chr(10) || chr(10) || {_q(DU.refusal.replace('{platform}', 'Kleinanzeigen'))} || chr(10) || chr(10) || 'Viele Grüße' ELSE {_sql_template()} END AS reply FROM part")
def reply_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies about parts: refused at high risk, else of what is known; the drafts are too short to pass."""
    k = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("listing_title"), F.lit("Eva Muster").alias("sender_name"), F.lit("Kleinanzeigen").alias("platform_name"), F.array(F.lit("kleinanzeigen.de")).alias("allowed_domains"), F.when(k % 11 == 0, "HIGH").otherwise("LOW").alias("level"),
        _pick(list(_INTENTS.values()), "p_partkey").alias("intent"), F.when(k % 2 == 0, F.col("p_retailprice").cast("double")).alias("offered_price"), _pick(list(_WAYS.values()), "p_partkey").alias("logistics"), F.when(k % 3 == 0, "kurz").alias("llm_draft"),
    )
    return reply.decide(rows, Settings()).select("p_partkey", F.col("reply_source").alias("source"), "reply")


@query("q_reply_problems", "SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 8 = 0 THEN 'enthält Link' END, CASE WHEN doc_id % 8 = 1 THEN 'enthält Telefonnummer' END, CASE WHEN doc_id % 8 = 2 THEN 'enthält E-Mail-Adresse' END, CASE WHEN doc_id % 8 = 3 THEN 'enthält Bankdaten' END, CASE WHEN doc_id % 8 = 4 THEN 'enthält Platzhalter' END, CASE WHEN doc_id % 8 = 5 THEN 'Formatfehler' END) AS problems FROM documents WHERE doc_id IS NOT NULL")
def reply_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts, one to a document, that offend in turn against each check, or hold an allowed link, or nothing to object to."""
    tails = ["siehe evil.info/x", "ruf 0171 1234567 an", "an max@gmail.com", "DE12 3704 0044 0532 0130 00", "liebe [PLZ]", '{"a": 1', "https://www.kleinanzeigen.de/x", "bis bald"]
    draft = F.concat(F.lit("Hallo, das geht gern so "), _pick(tails, "doc_id"))
    rows = _table(spark, sf_dir, "documents").where("doc_id is not null")
    return rows.select("doc_id", F.array_join(reply.problems(draft, F.array(F.lit("kleinanzeigen.de"))), "|").alias("problems"))


@query("q_logistics_labels", f"SELECT conv_id, turn, CASE WHEN p AND s THEN {_q(LABELS.logistics['BEIDES'])} WHEN p THEN {_q(LABELS.logistics['ABHOLUNG'])} WHEN s THEN {_q(LABELS.logistics['VERSAND'])} END AS label FROM (SELECT *, {_sql_free([heuristics.PICKUP])} AS p, {_sql_free([heuristics.SHIPPING])} AS s FROM {SQL_TURN_NORMS})")
def logistics_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a notification calls the guessed way of delivery; nothing where it isn't known."""
    turns = _turns(spark, sf_dir).withColumn("norm", T.normalize(F.col("text"))).withColumn("plain", T.plain(F.col("norm")))
    return turns.withColumn("way", heuristics.logistics(F.col("plain"))).select("conv_id", "turn", notify.label(F.col("way"), LABELS.logistics).alias("label"))


#: What is put behind a turn, in turn: an earlier price and an offer, a price alone, an offer with a blank in it, prices beyond the bounds, nothing.
_PRICES = (f" {'m' * 45} kostete 99,5 € und heute {'m' * 45} ich biete 1.250 eur", f" {'m' * 45} kostete 80,-", f" {'m' * 45} für 2 000 €", f" {'m' * 45} 0 € oder 200001 eur", "")
_SQL_PRICED = f"(SELECT conv_id, turn, (conv_id + turn) % 5 AS kind, text || {_sql_pick(list(_PRICES), '(conv_id + turn)')} AS text FROM {SQL_TURNS})"


@query("q_heuristic_intent", f"""
SELECT conv_id, turn, CASE WHEN kind IN (0, 2) THEN 'PREISVERHANDLUNG' WHEN regexp_matches(norm, {_q(heuristics.AVAILABLE)}) THEN 'VERFUEGBARKEIT' WHEN (p OR s) AND regexp_matches(norm, {_q(heuristics.APPOINTMENT)}) THEN 'TERMINABSPRACHE'
         WHEN regexp_matches(norm, {_q(heuristics.PURCHASE)}) THEN 'KAUFINTERESSE' WHEN contains(norm, '?') THEN 'FRAGE_ZUM_ARTIKEL' ELSE 'SONSTIGES' END AS guess_intent,
       CASE kind WHEN 0 THEN 1250.0::DOUBLE WHEN 1 THEN 80.0::DOUBLE WHEN 2 THEN 2000.0::DOUBLE END AS guess_price
FROM (SELECT *, {_sql_free([heuristics.PICKUP])} AS p, {_sql_free([heuristics.SHIPPING])} AS s FROM (SELECT *, {SQL_NORM} AS norm FROM {_SQL_PRICED}))""")
def heuristic_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents and prices of turns: an offer counts before an earlier price, other intents where there is no offer."""
    turns = _turns(spark, sf_dir).withColumn("k", F.col("conv_id") + F.col("turn"))
    priced = turns.withColumn("text", F.concat("text", _pick(list(_PRICES), "k"))).withColumn("allowed_domains", F.array().cast("array<string>"))
    return heuristics.with_heuristics(risk.with_context(priced)).select("conv_id", "turn", "guess_intent", "guess_price")
