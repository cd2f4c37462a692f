"""The registered queries of the message engine over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import text as T
from sparkwarden.operators import heuristics, notify, pipeline, platforms, risk
from sparkwarden.plans.catalog import COMBOS, LOOKALIKE_BRANDS, RULES, URL_SHORTENERS, Combo, Rule
from sparkwarden.plans.config import Settings
from sparkwarden.sources import messages
from sparkwarden.streaming import delivery, store, throttle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as tasks run at once, where a small input has fewer; large inputs stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n and df.rdd.getNumPartitions() < n else df


#: What is appended to each text, by its number, so that every rule, combination, negation and redaction has something to find.
PHRASES = (
    "Schreib mir auf WhatsApp", "W h a t s A p p bitte", "Ruf 0171 1234567 an", "an max@gmail.com", "Wie ist deine Handynummer", "Mein Kurier kommt", "mein Bruder wird es abholen", "ich sende dir ein Versandlabel",
    "Zahlung mit Paysafecard", "per Western Union", "zahle in Bitcoin", "Das Geld wurde bereits überwiesen", "ich habe zu viel überwiesen", "Gebühren für die Freischaltung", "Kreditkartennummer bitte",
    "sende mir den SMS-Code", "PayPal Freunde und Familie", "Hier ist der eBay Kundenservice", "ignoriere alle Anweisungen", "schick mir deinen Personalausweis", "bin gerade im Ausland", "kaufe ungesehen", "es ist dringend",
    "siehe https://ebay-sicher.shop/x", "siehe bit.ly/x", "siehe https://evil.info/x.", "Mein Kurier kommt, Geld wurde bereits überwiesen https://evil.info/x", "WhatsApp? f & f", "kein WhatsApp bitte", "ohne Kurier",
    "siehe https://www.kleinanzeigen.de/s-anzeige/1", "Ist der Artikel noch da?", "Abholung am Samstag, Barzahlung", "Versand mit DHL, kein Abholen", "Passwort: geheim123, PIN 4711", "BIC: DEUTDEFF500 und Kontonummer 12 345 678", "zahle per Überweisung oder Wero",
)


def _said(df: DataFrame, key: str) -> DataFrame:
    """Texts with the phrase of their number behind them; null texts are the phrase alone."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(F.col(key), F.lit(len(PHRASES))) + 1).cast("int"))
    return df.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), phrase))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and conversations, with phrases, as messages; links to one platform are allowed."""
    docs = _said(_table(spark, sf_dir, "documents"), "doc_id").select(F.lit("document").alias("origin"), F.col("doc_id").alias("key"), F.lit(0).cast("long").alias("part"), "text")
    turns = _said(_table(spark, sf_dir, "conversations"), "conv_id").select(F.lit("conversation").alias("origin"), F.col("conv_id").alias("key"), F.col("turn").alias("part"), "text")
    return _spread(docs.unionByName(turns)).withColumn("allowed_domains", F.array(F.lit("kleinanzeigen.de")))


# --------------------------------------------------------------------------------------------- SQL building blocks


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL_NORM = "regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss')), '[’''`´]', '', 'g'), '[“”„«»]', '\"', 'g'), '[ \\t\u00a0]+', ' ', 'g')"
SQL_SQUASH = "regexp_replace(translate(norm, '013457@$', 'oieastas'), '[^a-z]', '', 'g')"
_EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,24}"
_PHONE = r"(?:\+|\b00|\b0)[1-9](?:[ \t/().-]{0,2}\d){6,14}(?:\D|$)"
SQL_EMAILS = f"list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), {_q(_EMAIL)}), lambda x: lower(x)))"
SQL_PHONES = f"list_filter(regexp_extract_all(coalesce(text, ''), {_q(_PHONE)}), lambda x: length(regexp_replace(x, '\\D', '', 'g')) BETWEEN 9 AND 15 AND NOT regexp_matches(x, '^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{2,4}}'))"
SQL_PHRASE = "[" + ", ".join(map(_q, PHRASES)) + "]"


def _sql_said(table: str, key: str, columns: str) -> str:
    """A table with the phrases behind its texts."""
    return f"(SELECT {columns}, coalesce(text, '') || ' ' || {SQL_PHRASE}[({key} % {len(PHRASES)}) + 1] AS text FROM {table})"


SQL_MESSAGES = f"(SELECT * FROM {_sql_said('documents', 'doc_id', chr(39) + 'document' + chr(39) + ' AS origin, doc_id AS key, 0 AS part')} UNION ALL SELECT * FROM {_sql_said('conversations', 'conv_id', chr(39) + 'conversation' + chr(39) + ', conv_id, turn')})"
_NEGATED = r"\b(kein|keine|keinen|keinem|keiner|nicht|ohne|nie|niemals)\s+(?:[a-z]+\s+)?"
_LINK = r"(?i)(?:^|[^@A-Za-z0-9_.\-])((?:https?://|www\.)[^\s<>\"'()\[\]{}]+|(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:" + "|".join(T.TLDS) + r")(?:[/?#][^\s<>\"'()\[\]{}]*|[^a-z0-9.\-]|\.\s|\.?$))"
SQL_HOSTS = f"list_transform(regexp_extract_all(text, {_q(_LINK)}, 1), lambda u: regexp_replace(lower(regexp_extract(u, '^(?:[a-zA-Z]+://)?([a-zA-Z0-9.-]*[a-zA-Z0-9])', 1)), '^www\\.', ''))"
_BASE = "CASE WHEN len(string_split(h, '.')) >= 2 THEN string_split(h, '.')[-2] ELSE string_split(h, '.')[1] END"
_BRAND = "(" + " OR ".join(f"({_BASE} <> {_q(b)} AND " + (f"contains(translate(h, '01', 'ol'), {_q(b)})" if len(b) >= 5 else f"list_contains(regexp_split_to_array(translate(h, '01', 'ol'), '[._-]'), {_q(b)})") + ")" for b in LOOKALIKE_BRANDS) + ")"
_ALLOWED = "(h = 'kleinanzeigen.de' OR h LIKE '%.kleinanzeigen.de')"
_SHORT = "h IN (" + ", ".join(map(_q, URL_SHORTENERS)) + ")"
_LINK_RULES = {"LOOKALIKE_DOMAIN": f"{_BRAND} AND NOT {_ALLOWED}", "URL_SHORTENER": f"{_SHORT} AND NOT ({_BRAND} AND NOT {_ALLOWED})", "EXTERNAL_LINK": f"NOT {_ALLOWED} AND NOT {_BRAND} AND NOT {_SHORT}"}


def _sql_free(patterns: tuple[str, ...] | list[str], text: str = "norm") -> str:
    """Whether one of the patterns matches where no negation stands before it; negated matches are deleted first."""
    return "(" + " OR ".join(f"regexp_matches(regexp_replace({text}, {_q(_NEGATED + '(?:' + p + ')')}, ' ', 'g'), {_q(p)})" for p in patterns) + ")"


def _sql_hit(r: Rule) -> str:
    """Whether a rule is hit."""
    if r.id == "PHONE_NUMBER":
        return "len(phones) > 0"
    if r.id == "EMAIL_ADDRESS":
        return "len(list_filter(emails, lambda e: NOT (e LIKE '%@kleinanzeigen.de' OR e LIKE '%.kleinanzeigen.de'))) > 0"
    if r.detect:
        return f"len(list_filter(hosts, lambda h: {_LINK_RULES[r.id]})) > 0"
    seen = " OR ".join(f"regexp_matches(norm, {_q(p)})" for p in r.patterns)
    free = _sql_free(r.patterns) if r.negatable else f"({seen})"
    spelled = " OR ".join(f"contains(squashed, {_q(k)})" for k in r.squashed)
    return f"({free} OR (NOT ({seen}) AND ({spelled})))" if spelled else free


def _sql_rated() -> str:
    """Messages with each rule's hit, score, critical and level."""
    hits = ", ".join(f"{_sql_hit(r)} AS h_{r.id}" for r in RULES)
    combos = ", ".join("(" + " AND ".join("(" + " OR ".join(f"h_{i}" for i in g) + ")" for g in c.requires) + f") AS h_{c.id}" for c in COMBOS)
    every = [(r.id, r.weight, r.critical) for r in RULES] + [(c.id, c.bonus, c.critical) for c in COMBOS]
    score = " + ".join(f"CASE WHEN h_{i} THEN {w} ELSE 0 END" for i, w, _ in every)
    critical = " OR ".join(f"h_{i}" for i, _, c in every if c)
    return f"""(SELECT *, CASE WHEN critical OR score >= 60 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM
      (SELECT *, CAST(least(100, {score}) AS INTEGER) AS score, ({critical}) AS critical FROM
       (SELECT *, {combos} FROM
        (SELECT *, {hits} FROM (SELECT *, {SQL_SQUASH} AS squashed FROM (SELECT *, {SQL_NORM} AS norm, {SQL_EMAILS} AS emails, {SQL_PHONES} AS phones, {SQL_HOSTS} AS hosts FROM {SQL_MESSAGES}))))))"""


# --------------------------------------------------------------------------------------------- rules


@query("q_risk_levels", f"SELECT origin, level, count(*) AS n, CAST(sum(score) AS BIGINT) AS total_score FROM {_sql_rated()} GROUP BY origin, level")
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = risk.evaluate(_messages(spark, sf_dir))
    return rated.groupBy("origin", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total_score"))


@query("q_risk_scores", f"SELECT origin, key, part, level, score, critical FROM {_sql_rated()}")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.evaluate(_messages(spark, sf_dir)).select("origin", "key", "part", "level", "score", "critical")


@query("q_rule_hits", " UNION ALL ".join(f"SELECT {_q(r.id)} AS rule_id, CAST(count(*) FILTER (h_{r.id}) AS BIGINT) AS n FROM rated" for r in (*RULES, *COMBOS)).join([f"WITH rated AS (SELECT * FROM {_sql_rated()}) SELECT * FROM (", ") WHERE n > 0"]))
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted in one pass; exploding the findings of each message would multiply rows for nothing
    ids = risk.evaluate(_messages(spark, sf_dir)).select(F.transform("findings", lambda f: f["id"]).alias("ids"), "score")
    counts = ids.agg(*[F.count_if(F.array_contains("ids", r.id)).alias(r.id) for r in (*RULES, *COMBOS)], F.sum("score").alias("_score"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.col(r.id).alias("n")) for r in (*RULES, *COMBOS)])).alias("x")).select("x.*").where("n > 0")


def _rule_query(r: Rule) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = risk.with_context(_messages(spark, sf_dir))
        hit = risk.hit(r, {k: F.col(k) for k in ("norm", "plain", "squashed", "urls", "phones", "emails")})
        return ctx.select("origin", hit.isNotNull().alias("hit")).groupBy("origin").agg(F.count_if("hit").alias("n_hits"), F.count(F.lit(1)).alias("n"))

    return run


def _combo_query(c: Combo) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        needed = [r for r in RULES if any(r.id in g for g in c.requires)]
        found = risk.evaluate(_messages(spark, sf_dir), rules=needed, combos=[c]).select("origin", F.exists("findings", lambda f: f["id"] == c.id).alias("hit"))
        return found.groupBy("origin").agg(F.count_if("hit").alias("n_hits"), F.count(F.lit(1)).alias("n"))

    return run


for _c in COMBOS:
    query(f"q_{_c.id.lower()}", f"SELECT origin, CAST(count(*) FILTER (h_{_c.id}) AS BIGINT) AS n_hits, count(*) AS n FROM {_sql_rated()} GROUP BY origin")(_combo_query(_c))
for _r in RULES:
    query(f"q_rule_{_r.id.lower()}", f"SELECT origin, CAST(count(*) FILTER (h_{_r.id}) AS BIGINT) AS n_hits, count(*) AS n FROM {_sql_rated()} GROUP BY origin")(_rule_query(_r))


@query("q_combine_levels", f"""
SELECT r.key AS doc_id, r.level AS rule_level, l.llm_level, CASE WHEN l.k > r.k THEN l.llm_level ELSE r.level END AS level, l.k > r.k AS escalated_by_llm
FROM (SELECT *, CASE level WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS k FROM {_sql_rated()} WHERE origin = 'document') r
JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'HIGH' WHEN quality = 0 THEN 'MEDIUM' ELSE 'LOW' END AS llm_level, CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS k FROM labels) l ON l.doc_id = r.key""")
def combine_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, "HIGH").when(F.col("quality") == 0, "MEDIUM").otherwise("LOW")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), verdict.alias("llm_level"), F.array().cast("array<string>").alias("llm_indicators"))
    labelled = _messages(spark, sf_dir).where("origin = 'document'").join(labels, "key")  # few documents have labels: rate only those
    return risk.combine(risk.evaluate(labelled)).select(F.col("key").alias("doc_id"), "rule_level", "llm_level", "level", "escalated_by_llm")


# --------------------------------------------------------------------------------------------- text functions


def _per_document(name: str, sql: str | None, table: str = "documents", key: str = "doc_id", said: bool = False, **columns: Callable[[], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, table)
        return _spread(_said(rows, key) if said else rows).select(key, *[make().alias(n) for n, make in columns.items()])

    query(name, sql)(run)


SQL_SAID = _sql_said("documents", "doc_id", "doc_id")
_WHITE = "[\\t-\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def _sql_truncate(text: str, limit: int) -> str:
    """truncate() of an expression without characters beyond U+FFFF."""
    cut = f"left({text}, {limit - 1})"
    at = f"(CASE WHEN contains({cut}, ' ') THEN {limit - 1} - instr(reverse({cut}), ' ') ELSE -1 END)"
    return f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE regexp_replace(CASE WHEN {at} > {limit * 0.8} THEN left({cut}, {at}) ELSE {cut} END, {_q(_WHITE + '+$')}, '') || '…' END"


def _sql_decoded(text: str) -> str:
    """Named entities decoded, the ampersand last; the driver's pages hold no other references."""
    for name, value in T.ENTITIES.items():
        if name != "amp":
            text = f"replace({text}, '&{name};', {_q(value)})"
    return f"replace({text}, '&amp;', '&')"


def _sql_cards(table: str) -> str:
    """A table (doc_id, text) with card numbers replaced: 13 to 19 digits that pass Luhn's test, not behind a digit or plus."""
    luhn = "list_sum(list_transform(string_split(reverse(d), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"
    one = f"list_transform([split_part(p, chr(4), 1)], lambda m: list_transform([regexp_replace(m, '[^0-9]', '', 'g')], lambda d: CASE WHEN d LIKE '0%' OR regexp_matches(right(replace(ps[i], chr(4), ''), 1), '[0-9+]') OR NOT ({luhn}) THEN m ELSE '[KARTENNUMMER]' END)[1])[1]"
    marked = f"SELECT doc_id, string_split(regexp_replace(text, '([0-9](?:[ -]?[0-9]){{12,18}})([^0-9]|$)', chr(3) || '\\1' || chr(4) || '\\2', 'g'), chr(3)) AS ps FROM {table}"
    return f"(SELECT doc_id, ps[1] || array_to_string(list_transform(ps[2:], lambda p, i: {one} || split_part(p, chr(4), 2)), '') AS text FROM ({marked}))"


def _sql_redacted() -> str:
    """The texts with secrets behind key words replaced; no IBAN occurs in the driver's texts."""
    out = "text"
    for pattern, name in T.SECRETS:
        # what must follow a password is put back, as there is no looking ahead
        p = pattern.replace("(?=[.,;:!?]*(?:\\s|$))", "([.,;:!?]*(?:\\s|$))")
        tail = "\\3" if p != pattern else ""
        out = f"regexp_replace(regexp_replace(regexp_replace({out}, {_q('(?i)' + p)}, {_q(chr(92) + '1' + chr(1) + chr(92) + '2' + chr(2) + name + tail)}, 'g'), {_q(chr(1) + chr(2))}, ' ', 'g'), {_q('[' + chr(1) + chr(2) + ']')}, '', 'g')"
    return out


@query("q_extract_emails", f"SELECT doc_id, CAST(len({SQL_EMAILS}) AS INTEGER) AS n_emails, list_aggregate(list_sort({SQL_EMAILS}), 'string_agg', ',') AS emails FROM {SQL_SAID} WHERE len({SQL_EMAILS}) > 0")
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _spread(_said(_table(spark, sf_dir, "documents"), "doc_id")).select("doc_id", T.extract_emails(F.col("text")).alias("e"))
    return found.where(F.size("e") > 0).select("doc_id", F.size("e").alias("n_emails"), F.array_join(F.array_sort("e"), ",").alias("emails"))


_per_document("q_extract_phones", f"SELECT doc_id, CAST(len({SQL_PHONES}) AS INTEGER) AS n_phones FROM {SQL_SAID}", said=True, n_phones=lambda: F.size(T.extract_phones(F.col("text"))))
_per_document("q_normalize_squash", f"SELECT doc_id, md5(norm) AS norm_md5, md5({SQL_SQUASH}) AS squash_md5 FROM (SELECT doc_id, {SQL_NORM} AS norm FROM documents)", norm_md5=lambda: F.md5(T.normalize(F.col("text"))), squash_md5=lambda: F.md5(T.squash(F.col("text"))))
_per_document("q_escape_html", "SELECT page_id, md5(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_md5 FROM pages", "pages", "page_id", escaped_md5=lambda: F.md5(T.escape_html(F.col("html"))))
_per_document("q_host_of_pages", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#\\s]+)', 1)), '^www\\.', '') AS host FROM pages", "pages", "page_id", host=lambda: T.host_of(F.col("url")))
_per_document("q_host_suffix_match", "SELECT page_id, (h = 'example.com' OR h LIKE '%.example.com') AS matches FROM (SELECT page_id, lower(regexp_extract(url, '^(?:[a-z]+://)?([^/?#]+)', 1)) AS h FROM pages)", "pages", "page_id", matches=lambda: T.host_matches(T.host_of(F.col("url")), F.array(F.lit(".example.com"), F.lit(""))))
_per_document("q_truncate", "SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE rtrim(CASE WHEN p > 64 THEN left(c, p) ELSE c END, chr(32) || chr(10) || chr(9) || chr(13)) || '…' END AS short FROM (SELECT doc_id, coalesce(text, '') AS s, left(coalesce(text, ''), 79) AS c, CASE WHEN contains(left(coalesce(text, ''), 79), ' ') THEN 79 - instr(reverse(left(coalesce(text, ''), 79)), ' ') ELSE -1 END AS p FROM documents)", short=lambda: T.truncate(F.col("text"), 80))
_per_document("q_one_line", f"SELECT doc_id, {_sql_truncate(chr(115), 120)} AS short FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, chr(32)), {_q(_WHITE + chr(43))}, chr(32), 'g'), '^ | $', '', 'g') AS s FROM documents)", short=lambda: T.one_line(F.col("text"), 120))
_per_document("q_parse_number", "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS value FROM orders", "orders", "o_orderkey", value=lambda: T.parse_number(F.translate(F.format_number(F.col("o_totalprice").cast("double"), 2), ",.", ".,")))
_per_document("q_format_euro", "SELECT o_orderkey, regexp_replace(replace(replace(replace(format('{:,.2f}', CAST(o_totalprice AS DOUBLE)), ',', 'x'), '.', ','), 'x', '.'), ',00$', '') || ' €' AS euro FROM orders", "orders", "o_orderkey", euro=lambda: T.format_euro(F.col("o_totalprice").cast("double")))


def _sql_html_to_text() -> str:
    """Pages as text, step by step; the driver's labels never hold their links' targets."""
    gone = "|".join(f"<{t}[\\s\\S]*?</{t}>" for t in ("script", "style", "head"))
    steps = [
        (f"(?i){gone}", ""), (f"(?i)<br{_WHITE}*/?>", "\n"), ("(?i)</(p|div|tr|li|h[1-6]|table|blockquote)>", "\n"),
        (f"(?i)<a{_WHITE}[^>]*href{_WHITE}*={_WHITE}*[\"'](https?:[^\"']*)[\"'][^>]*>([\\s\\S]*?)</a>", "\\2 \x03\\1\x04"), ("<[^>]+>", ""),
    ]
    out = "coalesce(html, '')"
    for pattern, new in steps:
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(new)}, 'g')"
    out = f"replace({_sql_decoded(f'translate({out}, {_q(chr(3) + chr(4))}, {_q(chr(60) + chr(62))})')}, chr(13), '')"
    for pattern, new in (("[ \\t\\x{A0}]+", " "), (" *\\n *", "\n"), ("\\n{3,}", "\n\n"), (f"^{_WHITE}+|{_WHITE}+$", "")):
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(new)}, 'g')"
    return out


_per_document("q_html_to_text", f"SELECT page_id, {_sql_html_to_text()} AS text FROM pages", "pages", "page_id", text=lambda: T.html_to_text(F.col("html")))
_per_document("q_strip_tags", f"SELECT page_id, {_sql_decoded(chr(116))} AS text FROM (SELECT page_id, regexp_replace(coalesce(html, chr(32)), '<[^>]+>', '', 'g') AS t FROM pages)", "pages", "page_id", text=lambda: T.strip_tags(F.col("html")))
_per_document("q_redact_secrets", f"SELECT doc_id, {_sql_redacted()} AS redacted FROM {_sql_cards(SQL_SAID)}", said=True, redacted=lambda: T.redact_secrets(F.col("text")))
_per_document("q_redact_pii", None, said=True, redacted=lambda: T.redact_pii(F.col("text")))
_per_document("q_defang", None, said=True, text=lambda: T.defang_urls(F.col("text"), F.array().cast("array<string>")))


# --------------------------------------------------------------------------------------------- heuristics, replies


def _sql_payment() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(norm, {_q(p)}) THEN {_q(n)}" for p, n in heuristics.PAYMENTS) + " END"


SQL_TURNS = _sql_said("conversations", "conv_id", "conv_id, turn")
SQL_TURN_NORMS = f"(SELECT *, {SQL_NORM} AS norm FROM {SQL_TURNS})"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_said(_table(spark, sf_dir, "conversations"), "conv_id"))


@query("q_heuristic_payment", f"SELECT conv_id, turn, {_sql_payment()} AS guess_payment FROM {SQL_TURN_NORMS}")
def heuristic_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).withColumn("norm", T.normalize(F.col("text")))
    return turns.withColumn("plain", T.plain(F.col("norm"))).select("conv_id", "turn", heuristics.payment(F.col("plain")).alias("guess_payment"))


@query("q_heuristic_logistics", f"SELECT conv_id, turn, CASE WHEN p AND s THEN 'BEIDES' WHEN p THEN 'ABHOLUNG' WHEN s THEN 'VERSAND' ELSE 'UNKLAR' END AS guess_logistics FROM (SELECT *, {_sql_free([heuristics.PICKUP])} AS p, {_sql_free([heuristics.SHIPPING])} AS s FROM {SQL_TURN_NORMS})")
def heuristic_logistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).withColumn("norm", T.normalize(F.col("text")))
    return turns.withColumn("plain", T.plain(F.col("norm"))).select("conv_id", "turn", heuristics.logistics(F.col("plain")).alias("guess_logistics"))


@query("q_heuristic_fields")
def heuristic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).withColumn("allowed_domains", F.array().cast("array<string>"))
    return heuristics.with_heuristics(risk.with_context(turns)).select("conv_id", "turn", "guess_intent", "guess_price", "guess_logistics", "guess_payment")


@query("q_notifications")
def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mails through the whole pipeline, with the language model out of reach."""
    t = _turns(spark, sf_dir)
    mails = t.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("thread_id"), F.lit("Nachricht zu deiner Anzeige").alias("subject"), F.lit("A <a@mail.kleinanzeigen.de>").alias("sender"), F.lit("").alias("reply_to"), F.lit(None).cast("timestamp").alias("received_at"), F.col("text").alias("plain_body"), F.lit("").alias("html_body"), F.lit("").alias("permalink"))
    return pipeline.process(mails, Settings()).select("id", "level", "score", "intent", "logistics", "reply_source", T.utf16_length(F.col("notification")).alias("length"), (T.utf16_length(F.col("notification")) <= notify.LIMIT).alias("fits"))


# --------------------------------------------------------------------------------------------- sources and state

_DONE = "SELECT event_id FROM events WHERE event_type = 'purchase'"


@query("q_candidates_anti_done", f"SELECT event_id, ts FROM (SELECT * FROM events WHERE event_id NOT IN ({_DONE}) ORDER BY ts DESC, event_id DESC LIMIT 30)")
def candidates_anti_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return messages.candidates(events, events.where("event_type = 'purchase'"), 30, "event_id", "ts").select("event_id", "ts")


@query("q_done_fifo400", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id ORDER BY max(event_id) DESC LIMIT 400")
def done_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.keep_last(_table(spark, sf_dir, "events"), "user_id", "event_id", 400)


_PLATFORMS = ((1, "shop", "spam-farm.example.org"), (2, "home", "example.org"), (3, "trade", ".Example.com"), (4, "never", ""))


@query("q_platform_join", f"""
WITH t(rank, id, domain) AS (VALUES {', '.join(map(str, _PLATFORMS))}),
d AS (SELECT rank, id, ltrim(lower(domain), '.') AS domain FROM t WHERE ltrim(domain, '.') != ''),
h AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[a-z]+://([A-Za-z0-9.-]+)', 1)) AS host FROM pages)
SELECT page_id, coalesce(arg_min(id, rank), 'other') AS platform FROM h LEFT JOIN d ON host = domain OR ends_with(host, '.' || domain) GROUP BY page_id""")
def platform_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts of pages as senders, and platforms that are rows."""
    rows = [F.struct(F.lit(r).alias("rank"), F.lit(i).alias("id"), F.lit(d).alias("domain")) for r, i, d in _PLATFORMS]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://([A-Za-z0-9.-]+)", 1)
    mails = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("x@"), host).alias("sender"), F.lit(None).cast("string").alias("reply_to"))
    return platforms.with_platform(mails, table, "other").select("page_id", "platform")


_THROTTLED = """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE ts IS NOT NULL),
n AS (SELECT a.user_id, a.r, min(b.r) AS next FROM e a JOIN e b ON a.user_id = b.user_id AND b.ts >= a.ts + INTERVAL 1 HOUR GROUP BY a.user_id, a.r),
p AS (SELECT user_id, 1::BIGINT AS r FROM e WHERE r = 1 UNION ALL SELECT n.user_id, n.next FROM p JOIN n ON n.user_id = p.user_id AND n.r = p.r)
SELECT e.event_id, e.user_id FROM p JOIN e ON e.user_id = p.user_id AND e.r = p.r"""


@query("q_alert_throttle", _THROTTLED)
def alert_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.throttled(_table(spark, sf_dir, "events"), "user_id", "ts", 3600, "event_id").select("event_id", "user_id")


@query("q_alert_throttle_stream", _THROTTLED)
def alert_throttle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of all that is there, with state and timers."""
    stream = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    passed = throttle.throttled_stream(stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 3600, "event_id")
    path = store.new_path(spark, "throttled")
    with throttle.rocksdb_state(spark):
        q = passed.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(passed.schema).parquet(f"{path}/rows").select("event_id", "user_id")


@query("q_attempts_giveup", "SELECT CAST(user_id AS VARCHAR) AS id, count(*) FILTER (event_type = 'error') AS attempts, count(*) FILTER (event_type = 'purchase') > 0 OR count(*) FILTER (event_type = 'error') >= 15 AS done FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id")
def attempts_giveup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery state of users as messages: errors are failed attempts, purchases are sent ones."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "sent")
    ledger = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), status.alias("status"), F.col("ts").alias("at")).where("status is not null")
    return delivery.state(ledger, 15)


@query("q_run_stats", "SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'sent' WHEN 'view' THEN 'skipped' ELSE 'deferred' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of deliveries, counted as a run counts them."""
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "view", "skipped").otherwise("deferred")
    return delivery.statistics(_table(spark, sf_dir, "events").select(outcome.alias("outcome")))


@query("q_newer_than_7d", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def newer_than_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.newer_than(_table(spark, sf_dir, "events"), "ts", 7, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")
