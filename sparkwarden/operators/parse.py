"""From a notification mail to the message a person wrote: platform, text between markers, sender, listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import text as T
from sparkwarden.functions.regex import SPACES, java
from sparkwarden.plans.catalog import PLATFORMS, Platform

#: Lines that begin a message, that end it, and that never belong to it. All ignore case.
START = (
    r"^\s*(neue\s+)?nachricht\s+von\b\s*:?\s*[^:\n]{1,60}:?\s*$",
    r"^\s*[^:\n]{1,60}\s+(schreibt|schrieb|hat\s+geschrieben)\s*:\s*$",
    r"hat\s+(dir|ihnen)\s+.{0,60}nachricht.{0,60}(geschickt|gesendet|geschrieben)\s*:?\s*$",
    r"^\s*(deine\s+|ihre\s+)?(nachricht|nachrichtentext|message)\s*:\s*",
)
END = (
    r"^\s*(--\s?|—+|_{3,}|-{3,}|={3,})\s*$",
    r"^\s*(am|on)\s.{3,80}(schrieb|wrote)\b.{0,80}:\s*$",
    r"^\s*(antworten|jetzt antworten|nachricht beantworten|zur nachricht|zum chat|antwort senden|reply)\s*(<[^>]*>)?\s*$",
    r"^\s*(von meinem|sent from my|gesendet von)\s",
    r"sicherheitshinweis|sicherheitstipp|tipps?\s+f(ü|ue)r\s+(deine|ihre|mehr)\s+sicherheit|so\s+sch(ü|ue)tzt\s+du\s+dich|achtung\s*:?\s*betrug",
    r"(beantworte|antworte)\s.{0,40}(auf\s+diese|über\s+die|ueber\s+die|in\s+der)\s+(e-?mail|nachricht|app)",
    r"diese\s+(e-?mail|nachricht)\s+wurde\s+(automatisch|an)",
    r"(du\s+erh(ä|ae)ltst|sie\s+erhalten)\s+diese",
    r"^\s*(impressum|datenschutz|hilfe|kontakt|abmelden|newsletter|einstellungen|agb)\b",
    r"(kleinanzeigen|willhaben)[^\n]{0,20}(gmbh|internet\s+service|&\s*co)",
)
BOILERPLATE = (r"^\s*(anzeige|artikel|anzeigennummer|anzeigen-?nr\.?)\s*[:#]", r"^\s*\[(image|bild)[^\]]*\]\s*$")
#: Where a sender's name stands in a body, in order of trial.
SENDER = (
    r"nachricht\s+von\s*:?\s*([^\n:]{2,40}?)(?:\s+erhalten)?\s*:?\s*$",
    r"^\s*([^\n:]{2,40}?)\s+hat\s+(?:dir|ihnen)\s+.{0,60}nachricht",
    r"^\s*([^\n:]{2,40}?)\s+hat\s+(?:dir\s+|ihnen\s+)?eine\s+frage",
    r"^\s*([^\n:]{2,40}?)\s+schreibt\s*:\s*$",
    r"new\s+message\s+from\s*:?\s*([^\n:]{2,40}?)\s*$",
)


def normalize_body(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(T.text_of(c), "\\r\\n?", "\n"), "[\\u200B-\\u200D\\uFEFF]", "")
    return F.regexp_replace(F.replace(s, F.lit(" "), F.lit(" ")), "[ \\t]+(?=\\n|(?![\\s\\S]))", "")


def _any_matches(hosts: Column, domains: Column) -> Column:
    return F.exists(hosts, lambda h: T.host_matches(h, domains))


def detect_platform(sender: Column, reply_to: Column, platforms: Sequence[Platform] = PLATFORMS) -> Column:
    """The id of the first platform one of whose sender domains an address has; else the last platform's."""
    domains = F.regexp_extract_all(F.lower(F.concat_ws(" ", T.text_of(sender), T.text_of(reply_to))), F.lit("@([a-z0-9.-]+)"), 1)
    out = F.lit(platforms[-1].id)
    for p in reversed(platforms[:-1]):
        out = F.when(_any_matches(domains, F.array(*map(F.lit, p.sender_domains))), p.id).otherwise(out)
    return out


def by_platform(platform: Column, value, platforms: Sequence[Platform] = PLATFORMS) -> Column:
    """value(platform) as a column, by a row's platform id."""
    out = value(platforms[-1])
    for p in platforms[:-1]:
        out = F.when(platform == p.id, value(p)).otherwise(out)
    return out


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{java(p, 'i')})" for p in patterns)


def _cleaned(lines: Column, allowed: Column) -> Column:
    """Without quoted lines, boilerplate and lines that are a link to the platform; at most one empty line; without wrapping quotes."""
    link = f"^<?((?i:https?)://[^{SPACES}]+?)>?(?![\\s\\S])"

    def boiler(line: Column) -> Column:
        bare = T.trim(line)
        return bare.rlike(_any_of(BOILERPLATE)) | (bare.rlike(link) & T.host_matches(T.host_of(F.regexp_extract(bare, link, 1)), allowed))

    kept = F.filter(lines, lambda line: ~line.rlike(f"^[{SPACES}]*>") & ~boiler(line))
    text = T.trim(F.regexp_replace(F.array_join(kept, "\n"), "\\n{3,}", "\n\n"))
    quotes = "^[„\"»“]([\\s\\S]*)[“\"«”](?![\\s\\S])"
    return F.when(text.rlike(quotes), T.trim(F.regexp_extract(text, quotes, 1))).otherwise(text)


def extract_message(df: DataFrame, body: str = "body", platform: str = "platform", out: str = "text", platforms: Sequence[Platform] = PLATFORMS) -> DataFrame:
    """df with the message's text and `extraction`: MARKER (a start was found), HEURISTIK (an end only) or VOLLTEXT (neither)."""
    p = F.col(platform)
    starts, ends = (by_platform(p, lambda x, g=g, a=a: F.lit(_any_of((*g, *getattr(x, a)))), platforms) for g, a in ((START, "start_markers"), (END, "end_markers")))
    allowed = by_platform(p, lambda x: _strings(x.link_domains), platforms)
    one = df.withColumns({"_lines": F.split(normalize_body(F.col(body)), "\n"), "_starts": starts, "_ends": ends, "_allowed": allowed})
    two = one.withColumn("_at", F.array_position(F.transform("_lines", lambda x: F.regexp_like(x, F.col("_starts"))), True))
    line = F.when(F.col("_at") > 0, F.element_at("_lines", F.col("_at").cast("int"))).otherwise("")
    rest = F.when(F.col("_at") > 0, F.substring(line, F.regexp_instr(line, F.col("_starts")) + F.char_length(F.regexp_substr(line, F.col("_starts"))), F.lit(1 << 30))).otherwise("")
    three = two.withColumn("_rest", T.trim(F.regexp_replace(rest, f"^[{SPACES}]*[:\\-–][{SPACES}]*", "")))
    begin = F.when(F.col("_at") == 0, 1).when(F.col("_rest") != "", F.col("_at")).otherwise(F.col("_at") + 1).cast("int")
    tail = F.slice("_lines", begin, F.greatest(F.size("_lines") - begin + 1, F.lit(0)))
    tail = F.when((F.col("_at") > 0) & (F.col("_rest") != ""), F.concat(F.array("_rest"), F.slice("_lines", begin + 1, F.greatest(F.size("_lines") - begin, F.lit(0))))).otherwise(tail)
    four = three.withColumn("_tail", tail)
    five = four.withColumn("_end", F.array_position(F.transform("_tail", lambda x: F.regexp_like(x, F.col("_ends"))), True))
    cut = F.when(F.col("_end") > 0, F.slice("_tail", 1, F.greatest(F.col("_end").cast("int") - 1, F.lit(0)))).otherwise(F.col("_tail"))
    six = five.withColumn("_cut", F.when(F.rand(1) >= 0, _cleaned(cut, F.col("_allowed"))))  # a barrier, as in risk.evaluate
    good = T.utf16_length(F.col("_cut")) >= 2
    how = F.when(good & (F.col("_at") > 0), "MARKER").when(good & (F.col("_end") > 0), "HEURISTIK").otherwise("VOLLTEXT")
    done = six.withColumns({out: F.when(good, F.col("_cut")).otherwise(_cleaned(F.col("_lines"), F.col("_allowed"))), "extraction": how})
    return done.drop("_lines", "_starts", "_ends", "_allowed", "_at", "_rest", "_tail", "_end", "_cut")


def listing_title(subject: Column) -> Column:
    """What stands in quotes, or behind the word for a listing; null if there is neither."""
    s = T.trim(F.regexp_replace(T.text_of(subject), java(r"^\s*((re|aw|fwd?|wg)\s*:\s*)+", "i"), ""))
    quoted = F.regexp_extract(s, "[„\"»“]([^„\"»“”«]{2,120})[“\"«”]", 1)
    after = F.regexp_extract(s, java(r"(?:anzeige|artikel|inserat)\s*[:\-–]?\s*(.{2,120})$", "i"), 1)
    return F.when(quoted != "", T.trim(quoted)).when(after != "", T.trim(after))


def sender_name(sender: Column, body: Column) -> Column:
    """The display name unless it is a platform's, else the first name found in the body; null if there is none."""
    shown = T.trim(F.regexp_replace(T.trim(F.regexp_extract(T.text_of(sender), f"^[{SPACES}]*\"?([^\"<]*?)\"?[{SPACES}]*<", 1)), java(r"\s+(über|ueber|via)\s+\S.*$", "i"), ""))
    shown = F.when(~shown.rlike(java(r"kleinanzeigen|willhaben|ebay|no-?reply|nachricht|service|team|^info$", "i")), T.blank_to_null(shown))
    found = F.coalesce(shown, *[T.blank_to_null(T.trim(F.regexp_extract(T.text_of(body), java(p, "im"), 1))) for p in SENDER], F.lit(""))
    name = T.trim(F.regexp_replace(F.regexp_replace(found, java(r"\s*\(\s*\d[\d.,]*\s*[★⭐]?\s*\)\s*$"), ""), '[<>\\r\\n"]', ""))
    return F.when((name != "") & ~name.rlike(java(r"^(du|sie|jemand|ein nutzer|ein interessent)$", "i")), T.one_line(name, 40))


def parse(df: DataFrame, skip_subjects: Sequence[str] = (), allowed_domains: Sequence[str] = (), platforms: Sequence[Platform] = PLATFORMS, detected: bool = False) -> DataFrame:
    """Mails (id, thread_id, subject, sender, reply_to, received_at, plain_body, html_body, permalink) as messages.

    The plain body serves if it has 20 characters or more, else the HTML as text. skip_reason says why a mail isn't to be analysed.
    With `detected` the mails bring the column platform (operators.platforms), else it comes from `platforms`.
    """
    plain = T.text_of(F.col("plain_body"))
    html = T.html_to_text(F.when(T.text_of(F.col("html_body")) != "", F.col("html_body")).otherwise(plain))
    one = df.withColumns({"platform": F.col("platform") if detected else detect_platform(F.col("sender"), F.col("reply_to"), platforms), "raw_body": F.when(T.utf16_length(T.trim(plain)) >= 20, plain).otherwise(html), "subject": T.text_of(F.col("subject")), "permalink": T.text_of(F.col("permalink"))})
    two = extract_message(one, "raw_body", "platform", "text", platforms)
    links = by_platform(F.col("platform"), lambda p: _strings(p.link_domains), platforms)
    three = two.withColumns({"platform_name": by_platform(F.col("platform"), lambda p: F.lit(p.name), platforms), "allowed_domains": F.concat(links, _strings(allowed_domains)), "sender_name": sender_name(F.col("sender"), F.col("raw_body")), "listing_title": listing_title(F.col("subject")), "_links": links, "_urls": T.extract_urls(F.col("raw_body"))})
    path = by_platform(F.col("platform"), lambda p: F.lit(java(p.listing_path, "i")) if p.listing_path else F.lit(None).cast("string"), platforms)
    url = F.get(F.filter("_urls", lambda u: T.host_matches(u["host"], F.col("_links")) & F.coalesce(F.regexp_like(u["url"], path), F.lit(False))), F.lit(0))["url"]
    reason = F.when(F.col("text") == "", "leer")
    for s in reversed(list(skip_subjects)):
        reason = F.when(F.col("subject").rlike(java(s, "i")), f"Betreff enthält {s}").otherwise(reason)
    four = three.withColumn("_url", url).withColumn("listing_url", F.when(F.col("_url").rlike("(?i)^https?://"), F.regexp_replace("_url", "(?i)^http:", "https:")).otherwise(F.concat(F.lit("https://"), F.col("_url"))))
    return four.withColumn("skip_reason", reason).drop("_links", "_urls", "_url")
