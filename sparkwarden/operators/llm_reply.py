"""Replies of a language model, read robustly: JSON somewhere in a text, made into a fixed set of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import text as T
from sparkwarden.functions.regex import SPACES, java

#: Fixed values.
INTENTS = ("KAUFINTERESSE", "PREISVERHANDLUNG", "VERFUEGBARKEIT", "FRAGE_ZUM_ARTIKEL", "TERMINABSPRACHE", "SONSTIGES")
LOGISTICS = ("ABHOLUNG", "VERSAND", "BEIDES", "UNKLAR")
EMPTY_WORDS = r"^(null|none|n\/a|keine?|-|unbekannt|unklar)$"


def extract_json(content: Column) -> Column:
    """The text from the first { to the last }, without thoughts, fences and commas before a closing bracket; null if there is none."""
    s = T.trim(F.regexp_replace(T.text_of(content), "(?i)<think>[\\s\\S]*?</think>", ""))
    s = F.regexp_replace(F.regexp_replace(s, f"^```[a-zA-Z]*[{SPACES}]*", ""), f"[{SPACES}]*```[{SPACES}]*(?![\\s\\S])", "")
    return T.blank_to_null(F.regexp_extract(s, "\\{[\\s\\S]*\\}", 0))


def parsed(json: Column) -> Column:
    """A variant; what doesn't parse is tried again without trailing commas. Null if it isn't an object."""
    v = F.coalesce(F.try_parse_json(json), F.try_parse_json(F.regexp_replace(json, ",\\s*([}\\]])", "$1")))
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def key(value: Column) -> Column:
    s = F.upper(T.trim(T.text_of(value)))
    for a, b in (("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, f"[{SPACES}-]+", "_")


def intent_of(value: Column) -> Column:
    k, has = key(value), lambda x: F.contains(key(value), F.lit(x))
    return F.when(k.isin(*INTENTS), k).when(has("PREIS") | has("VERHANDL"), "PREISVERHANDLUNG").when(has("VERFUEG"), "VERFUEGBARKEIT").when(has("TERMIN"), "TERMINABSPRACHE").when(has("FRAGE"), "FRAGE_ZUM_ARTIKEL").when(has("KAUF"), "KAUFINTERESSE").otherwise("SONSTIGES")


def logistics_of(value: Column) -> Column:
    k, has = key(value), lambda x: F.contains(key(value), F.lit(x))
    pickup, shipping = has("ABHOL") | has("PICKUP"), has("VERSAND") | has("SHIP")
    return F.when(k.isin(*LOGISTICS), k).when(has("BEID") | (pickup & shipping), "BEIDES").when(pickup, "ABHOLUNG").when(shipping, "VERSAND").otherwise("UNKLAR")


def risk_of(value: Column) -> Column:
    k = key(value)
    return F.when(k.isin("HIGH", "HOCH", "HOHES"), "HIGH").when(k.isin("MEDIUM", "MITTEL", "MED"), "MEDIUM").when(k.isin("LOW", "NIEDRIG", "GERING"), "LOW")


def clean_text(value: Column, limit: int) -> Column:
    """Trimmed, with written-out line ends resolved; words for nothing are null."""
    s = T.trim(F.replace(value, F.lit("\\n"), F.lit("\n")))
    return F.when((s != "") & ~s.rlike(java(EMPTY_WORDS, "i")), T.truncate(s, limit))


def price_of(value: Column) -> Column:
    n = T.parse_number(value)
    return F.when((n > 0) & (n < 1000000), T.round_cents(n))


def _scalar(v: Column, path: str) -> Column:
    """A field as text; objects and lists are null."""
    field = F.try_variant_get(v, path, "variant")
    return F.when(~F.schema_of_variant(field).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(v, path, "string"))


def with_analysis(df: DataFrame, content: str = "llm_content") -> DataFrame:
    """df with llm_ok (whether the reply can be used: a JSON object with a draft or an intent) and the llm_ fields; all null if it can't."""
    one = df.withColumn("_v", parsed(extract_json(F.col(content))))
    names = {"intent": "intent", "summary": "summary", "price": "offeredPrice", "logistics": "logistics", "details": "logisticsDetails", "payment": "paymentMethod", "risk": "scamRisk", "draft": "replyDraft"}
    two = one.withColumns({f"_{k}": _scalar(F.col("_v"), f"$.{p}") for k, p in names.items()})
    several = F.try_variant_get("_v", "$.scamIndicators", "array<variant>")
    texts = F.transform(several, lambda x: F.when(~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(x, "$", "string")))
    two = two.withColumns({"_list": F.coalesce(texts, F.array(_scalar(F.col("_v"), "$.scamIndicators"))), "_draft": clean_text(F.col("_draft"), 1500)})
    ok = F.col("_v").isNotNull() & (F.col("_draft").isNotNull() | (T.text_of(F.col("_intent")) != ""))
    three = two.withColumn("llm_ok", ok)
    use = lambda c: F.when(F.col("llm_ok"), c)
    out = three.withColumns({
        "llm_intent": use(intent_of(F.col("_intent"))), "llm_summary": use(clean_text(F.col("_summary"), 300)), "llm_price": use(price_of(F.col("_price"))), "llm_logistics": use(logistics_of(F.col("_logistics"))), "llm_details": use(clean_text(F.col("_details"), 200)),
        "llm_payment": use(clean_text(F.col("_payment"), 80)), "llm_level": use(risk_of(F.col("_risk"))), "llm_indicators": use(F.slice(F.array_compact(F.transform("_list", lambda x: clean_text(x, 120))), 1, 5)), "llm_draft": use(F.col("_draft")),
    })
    return out.drop("_v", "_list", *[f"_{k}" for k in names])
