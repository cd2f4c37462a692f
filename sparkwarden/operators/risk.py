"""Risk by rules, and its combination with a language model's verdict, which may raise it but never lower it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import text as T
from sparkwarden.functions.regex import any_of, required
from sparkwarden.plans.catalog import COMBOS, HIGH_THRESHOLD, LOOKALIKE_BRANDS, MEDIUM_THRESHOLD, RULES, URL_SHORTENERS, Combo, Rule

#: The levels in order.
LEVELS = ("LOW", "MEDIUM", "HIGH")


def rank(level: Column) -> Column:
    """0 to 2; null for anything else."""
    return F.when(level == "LOW", 0).when(level == "MEDIUM", 1).when(level == "HIGH", 2)


def max_level(a: Column, b: Column) -> Column:
    """b if it ranks higher, else a."""
    return F.when(rank(b) > rank(a), b).otherwise(a)


def folded_hosts(hosts: Column) -> Column:
    """Hosts normalised, with 0 and 1 read as o and l; all hosts of a row in one go."""
    return F.split(F.translate(T.normalize(F.array_join(hosts, "\n")), "01", "ol"), "\n")


def borrows_brand(host: Column, folded: Column) -> Column:
    """Whether a host borrows a brand's name (short names as a whole part only) without being named after it alone."""
    labels = F.split(host, "\\.")
    base = F.element_at(labels, F.when(F.size(labels) >= 2, -2).otherwise(1))
    return _any([(F.contains(folded, F.lit(b)) if len(b) >= 5 else F.array_contains(F.split(folded, "[.\\-_]"), b)) & (base != b) for b in LOOKALIKE_BRANDS])


def with_context(df: DataFrame, text: str = "text", allowed: str = "allowed_domains") -> DataFrame:
    """df with norm, plain, squashed, urls (url, host, allowed, shortener, lookalike), phones and emails of the text."""
    c = F.col(text)
    first = df.withColumns({"_ok": F.coalesce(F.col(allowed), F.array().cast("array<string>")), "_low": T.lowered(c), "_urls": T.extract_urls(c), "phones": T.extract_phones(c), "emails": T.extract_emails(c)})
    first = first.withColumn("norm", T.folded(F.col("_low")))
    second = first.withColumns({"squashed": T.squash_normalized(F.col("norm")), "plain": T.plain(F.col("norm")), "_folded": folded_hosts(F.transform("_urls", lambda u: u["host"])), "emails": F.filter("emails", lambda e: ~T.host_matches(F.substring_index(e, "@", -1), F.col("_ok")))})
    rated = F.zip_with("_urls", F.slice("_folded", 1, F.size("_urls")), lambda u, f: F.struct(u["url"].alias("url"), u["host"].alias("host"), T.host_matches(u["host"], F.col("_ok")).alias("allowed"), u["host"].isin(*URL_SHORTENERS).alias("shortener"), borrows_brand(u["host"], f).alias("brand")))
    urls = F.transform("_rated", lambda u: F.struct(u["url"].alias("url"), u["host"].alias("host"), u["allowed"].alias("allowed"), u["shortener"].alias("shortener"), (u["brand"] & ~u["allowed"]).alias("lookalike")))
    return second.withColumn("_rated", rated).withColumn("urls", urls).drop("_ok", "_low", "_urls", "_folded", "_rated")


def _any(columns: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def literals_found(norm: Column, rules: Sequence[Rule]) -> Column:
    """The literals of all rules' patterns that a plain text holds, found in one pass, each behind a line end; of those that begin at the same place only the longest."""
    every = frozenset().union(*(s for r in rules for p in r.patterns for s in required(p)))
    return F.concat(F.lit("\n"), F.array_join(F.array_distinct(F.regexp_extract_all(norm, F.lit(f"(?=({any_of(every)}))"), 1)), "\n")) if every else F.lit("")


def hit(rule: Rule, ctx: dict[str, Column]) -> Column:
    """The evidence of a rule: '' or a host; null if it isn't hit.

    A pattern runs only on texts that hold a literal of each set that it needs: by ctx["literals"] (`literals_found` for this and
    other rules), where that is given, else by a search for each.
    """
    if rule.detect:
        return rule.detect(ctx)
    norm = ctx["plain"]

    def behind(p: str, found: Column) -> Column:
        held = [_any([F.contains(ctx["literals"], F.lit("\n" + x)) if "literals" in ctx else F.contains(norm, F.lit(x)) for x in sorted(need)]) for need in required(p)]
        return reduce(and_, [*held, found])

    seen = _any([behind(p, norm.rlike(p)) for p in rule.patterns])
    free = _any([behind(p, T.any_unnegated(norm, p)) for p in rule.patterns]) if rule.negatable else seen
    if not rule.squashed:
        return F.when(free, F.lit(""))
    spelled = _any([F.contains(ctx["squashed"], F.lit(k)) for k in rule.squashed]) & ~seen
    return F.when(free | spelled, F.lit(""))


def evaluate(df: DataFrame, text: str = "text", allowed: str = "allowed_domains", rules: Sequence[Rule] = RULES, combos: Sequence[Combo] = COMBOS, keep_context: bool = False) -> DataFrame:
    """df with level, score, critical and findings (id, label, weight, critical, evidence).

    The score is the sum of weights, 100 at most; findings stand critical ones first, then combinations, then by weight, then in
    catalog order. A null or empty text has no findings.
    """
    own = with_context(df, text, allowed)
    ctx = {k: F.col(k) for k in ("norm", "plain", "squashed", "urls", "phones", "emails")}
    own = own.withColumn("_literals", literals_found(ctx["plain"], rules))
    hits = own.withColumns({f"_hit_{r.id}": hit(r, ctx | {"literals": F.col("_literals")}) for r in rules})

    def finding(k: int, r: Rule | Combo, evidence: Column) -> Column:
        weight = r.weight if isinstance(r, Rule) else r.bonus
        return F.struct(F.lit(0 if r.critical else 1).alias("c"), F.lit(0 if isinstance(r, Combo) else 1).alias("k"), F.lit(-weight).alias("w"), F.lit(k).alias("n"), F.lit(r.id).alias("id"), F.lit(r.label).alias("label"), F.lit(weight).alias("weight"), F.lit(r.critical).alias("critical"), T.blank_to_null(evidence).alias("evidence"))

    single = [F.when(F.col(f"_hit_{r.id}").isNotNull(), finding(k, r, F.col(f"_hit_{r.id}"))) for k, r in enumerate(rules)]
    known = {r.id for r in rules}
    joint = []
    for k, c in enumerate(combos):
        whole = F.lit(True)
        for group in c.requires:
            whole = whole & _any([F.col(f"_hit_{i}").isNotNull() for i in group if i in known])
        joint.append(F.when(whole, finding(len(rules) + k, c, F.lit(""))))
    # rand() keeps the optimizer from pushing filters on the result below, where they would multiply the expressions
    found = hits.withColumn("_found", F.when(F.rand(1) >= 0, F.array_sort(F.array_compact(F.array(*single, *joint)))))
    score = F.least(F.lit(100), F.aggregate("_found", F.lit(0), lambda a, f: a + f["weight"]))
    scored = found.withColumns({"score": score, "critical": F.exists("_found", lambda f: f["critical"])})
    level = F.when(F.col("critical") | (F.col("score") >= HIGH_THRESHOLD), "HIGH").when(F.col("score") >= MEDIUM_THRESHOLD, "MEDIUM").otherwise("LOW")
    findings = F.transform("_found", lambda f: F.struct(*[f[c].alias(c) for c in ("id", "label", "weight", "critical", "evidence")]))
    out = scored.withColumns({"level": level, "findings": findings})
    return out.drop("_found", "_literals", *[f"_hit_{r.id}" for r in rules], *([] if keep_context else ctx))


def combine(df: DataFrame, llm_level: str = "llm_level", indicators: str = "llm_indicators") -> DataFrame:
    """df with rule_level, level (the higher of both; an unknown model level doesn't count), escalated_by_llm and at most five indicators."""
    known = F.when(rank(F.col(llm_level)).isNotNull(), F.col(llm_level))
    out = df.withColumns({"rule_level": F.col("level"), llm_level: known, indicators: F.slice(F.coalesce(F.col(indicators), F.array().cast("array<string>")), 1, 5)})
    raised = F.coalesce(rank(F.col(llm_level)) > rank(F.col("rule_level")), F.lit(False))
    return out.withColumns({"escalated_by_llm": raised, "level": F.when(raised, F.col(llm_level)).otherwise(F.col("rule_level"))})
