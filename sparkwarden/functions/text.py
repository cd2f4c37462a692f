"""Text functions as Catalyst expressions; no Python runs on the executors.

Replacements whose outcome depends on each match are made by marking the matches, splitting at the marks and transforming the
parts, so they stay in the JVM too. Two control characters serve as marks; a text's own ones become U+FFFD first.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache, partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden.functions.regex import BOUNDARY, SPACES, java, keyed, literals

OPEN, CLOSE = "\u0001", "\u0002"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def where(c: Column, need: Callable[[Column], Column], new: Callable[[Column], Column]) -> Column:
    """new(c) where need(c) holds, else c."""
    return let(c, lambda s: F.when(need(s), new(s)).otherwise(s))


def text_of(c: Column) -> Column:
    """The text; null is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def trim(c: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+(?![\\s\\S])", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def marked(c: Column, pattern: str) -> Column:
    """The parts of a text between matches: the first has no match, each other begins with one and CLOSE."""
    clean = F.regexp_replace(c, f"[{OPEN}{CLOSE}]", "\ufffd")
    return F.split(F.regexp_replace(clean, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN)


def _match(part: Column) -> Column:
    return F.substring_index(part, CLOSE, 1)


def _rest(part: Column) -> Column:
    return F.substring_index(part, CLOSE, -1)


def _pairs(parts: Column, make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(match, character before it, text behind it) for each match."""
    n = F.greatest(F.size(parts) - 1, F.lit(0))
    before = lambda a: F.right(F.replace(a, F.lit(CLOSE), F.lit("")), F.lit(1))
    return F.zip_with(F.slice(parts, 1, n), F.slice(parts, 2, n), lambda a, b: make(_match(b), before(a), _rest(b)))


def matches(c: Column, pattern: str, start: Callable[[Column], Column] | None = None) -> Column:
    """All matches in order; `start` may ask for the character before a match ('' at the beginning)."""

    def found(parts: Column) -> Column:
        pairs = _pairs(parts, lambda m, before, _: F.struct(m.alias("m"), before.alias("before")))
        return F.transform(pairs if start is None else F.filter(pairs, lambda p: start(p["before"])), lambda p: p["m"])

    return let(marked(c, pattern), found)


def replace_each(c: Column, pattern: str, new: Callable[[Column, Column], Column], need: str | None = None) -> Column:
    """The text with each match m replaced by new(m, character before it). `need` is a cheaper pattern that each match holds."""
    made = lambda s, parts: F.when(F.size(parts) > 1, F.concat(parts[0], F.array_join(_pairs(parts, lambda m, before, rest: F.concat(new(m, before), rest)), ""))).otherwise(s)
    return where(c, lambda s: s.rlike(need or pattern), lambda s: let(marked(s, pattern), lambda parts: made(s, parts)))


# ------------------------------------------------------------------------------------------------- normalising

#: Characters that don't show, look-alikes of Latin letters, digits and signs that stand for letters.
INVISIBLE = "[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ɑ": "a", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
NEGATION_BEFORE = r"\b(kein|keine|keinen|keinem|keiner|nicht|ohne|nie|niemals)\s+(?:[a-z]+\s+)?$"


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters that compatibility decomposition (less U+0300 to U+036F) turns into one, what into, and those it turns into several.

    Hangul syllables stay composed; no pattern concerns them.
    """
    a, b, gone, many = [], [], [], {}
    for code in range(128, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")
        d = "".join(HOMOGLYPHS.get(x, x) for x in d)
        if d == c:
            continue
        if len(d) == 1:
            a.append(c)
            b.append(d)
        elif d:
            many[c] = d
        else:
            gone.append(c)
    return "".join(a + gone), "".join(b), many


def _fold(c: Column) -> Column:
    """ASCII texts stay; texts of Latin letters up to U+017F (but for those that become several) need a small table only."""
    old, new, many = _folds()
    latin = [(a, b) for a, b in zip(old, new) if a <= "\u017f"]
    small = F.translate(c, "".join(a for a, _ in latin), "".join(b for _, b in latin))
    beyond = "[^\\x00-\\x{17F}]|[" + "".join(ch for ch in many if ch <= "\u017f") + "]"
    codes = sorted(map(ord, many))
    spans: list[list[int]] = []
    for k in codes:
        if spans and k == spans[-1][1] + 1:
            spans[-1][1] = k
        else:
            spans.append([k, k])
    several = "[" + "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in spans) + "]"
    table = F.map_from_arrays(F.split(F.lit("\u0001".join(many)), "\u0001"), F.split(F.lit("\u0001".join(many.values())), "\u0001"))
    # without let(): these expressions are cheap, and deep nesting is dear to analyse
    spread = F.when(c.rlike(several), F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), "")).otherwise(c)
    return F.when(F.octet_length(c) == F.char_length(c), c).when(~c.rlike(beyond), small).otherwise(F.translate(spread, old, new))


def lowered(c: Column) -> Column:
    """The first half of normalize: lower case, without invisible characters, ß as ss."""
    return F.replace(F.lower(F.regexp_replace(text_of(c), INVISIBLE, "")), F.lit("ß"), F.lit("ss"))


def folded(low: Column) -> Column:
    """The second half of normalize; `low` is best a column of its own, as it is named several times."""
    s = F.regexp_replace(F.regexp_replace(_fold(low), "[’'`´]", ""), "[“”„«»]", '"')
    return F.regexp_replace(s, "[ \\t\\u00A0]+", " ")


def normalize(c: Column) -> Column:
    """Lower case, without accents, look-alikes and invisible characters; quotes unified, blanks single, newlines kept."""
    return folded(lowered(c))


def squash_normalized(norm: Column) -> Column:
    return F.regexp_replace(F.translate(norm, "".join(LEET), "".join(LEET.values())), "[^a-z]", "")


def squash(c: Column) -> Column:
    """Letters a to z only, with digits and signs that stand for letters resolved."""
    return squash_normalized(normalize(c))


def plain(norm: Column) -> Column:
    """Normalised text in which what isn't ASCII is a sign (or, if white space, a white space) of one character.

    Patterns of ASCII letters match it as they match the text, and Java's word borders are ASCII's there.
    """
    bare = F.regexp_replace(F.regexp_replace(norm, "[\\u1680\\u2028\\u2029]", "\u000b"), "[^\\x00-\\x7F]", "\u00a7")
    return F.when(F.octet_length(norm) == F.char_length(norm), norm).otherwise(bare)


def any_unnegated(norm: Column, p: str) -> Column:
    """Whether a match of p in a plain text isn't preceded, within 40 characters, by a negation and at most one word."""
    before = lambda parts, k: F.right(F.replace(F.array_join(F.slice(parts, 1, k), ""), F.lit(CLOSE), F.lit("")), F.lit(40))
    free = lambda parts: F.exists(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: ~before(parts, k).rlike(NEGATION_BEFORE.replace("$", "\\z")))
    return F.when(norm.rlike(p), let(marked(norm, p), free)).otherwise(F.lit(False))


# ------------------------------------------------------------------------------------------------- HTML


def escape_html(c: Column) -> Column:
    s = text_of(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


#: The named entities that are decoded, with case.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "euro": "€", "ndash": "–", "mdash": "—",
    "hellip": "…", "bdquo": "„", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "shy": "",
}


def _character(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """Decimal, hexadecimal and named character references; unknown or impossible ones stay."""
    table = F.map_from_arrays(F.array(*map(F.lit, ENTITIES)), F.array(*map(F.lit, ENTITIES.values())))

    def one(m: Column, _: Column) -> Column:
        code = F.substring(m, 2, 1 << 30)
        code = F.regexp_replace(code, ";$", "")
        hexed = F.lower(F.substring(code, 1, 2)) == "#x"
        digits = F.regexp_replace(F.when(hexed, F.substring(code, 3, 1 << 30)).otherwise(F.substring(code, 2, 1 << 30)), "^0+(?=.)", "")
        number = F.when(F.char_length(digits) <= 8, F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
        good = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(F.substring(code, 1, 1) == "#", F.when(good, _character(number)).otherwise(m)).otherwise(F.coalesce(F.element_at(table, code), m))

    return replace_each(text_of(c), "&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);", one)


def strip_tags(c: Column) -> Column:
    return decode_entities(F.regexp_replace(text_of(c), "<[^>]+>", ""))


def html_to_text(c: Column) -> Column:
    """Readable text of HTML; a link's target follows its label in angle brackets unless the label holds it."""
    s = F.regexp_replace(text_of(c), "[\\u0001\\u0002]", "")
    s = F.regexp_replace(s, "(?i)<(script|style|head)[\\s\\S]*?</\\1>", "")
    s = F.regexp_replace(s, f"(?i)<br[{SPACES}]*/?>", "\n")
    s = F.regexp_replace(s, "(?i)</(p|div|tr|li|h[1-6]|table|blockquote)>", "\n")
    w = f"[{SPACES}]"
    anchor = f"(?i)<a{w}[^>]*href{w}*={w}*[\"']([^\"']*)[\"'][^>]*>([\\s\\S]*?)</a>"
    bare = f"(?i)<a{w}[^>]*href{w}*={w}*[\"'][^\"']*[\"'][^>]*>[\\s\\S]*?</a>"

    def link(m: Column, _: Column) -> Column:
        href, label = F.regexp_extract(m, anchor, 1), F.regexp_extract(m, anchor, 2)
        return F.concat(label, F.when(href.rlike("(?i)^https?:") & ~F.contains(label, href), F.concat(F.lit(" \u0003"), href, F.lit("\u0004"))).otherwise(F.lit("")))

    s = replace_each(F.translate(s, "\u0003\u0004", "\ufffd\ufffd"), bare, link)
    s = F.translate(F.regexp_replace(s, "<[^>]+>", ""), "\u0003\u0004", "<>")
    s = F.replace(decode_entities(s), F.lit("\r"), F.lit(""))
    s = F.regexp_replace(F.regexp_replace(s, "[ \\t\\u00A0]+", " "), " *\\n *", "\n")
    return trim(F.regexp_replace(s, "\\n{3,}", "\n\n"))


# ------------------------------------------------------------------------------------------------- finding

#: Top-level domains under which a name without scheme is a link.
TLDS = (
    "de at ch li lu com net org info biz eu io co me ly gl gd cc to tv app xyz top online site shop store link live click icu vip pro ru cn su tk ml ga cf gq pw ws uk fr it es nl be pl cz sk hu ro bg tr ua us ca in "
    "cloud club website space fun buzz page support help pay bank money delivery express services"
).split()
_L = "a-z0-9\\u00C0-\\u024F\\u0370-\\u03FF\\u0400-\\u04FF"
_LABEL = f"[{_L}](?:[{_L}-]{{0,61}}[{_L}])?"
_PATH = f"[^{SPACES}<>\"'()\\[\\]{{}}]"
#: Where a name can begin that doesn't begin before: not within one, but behind hyphens it can't hold and 63 characters before the dot of a longer one.
_NAME_START = f"(?:(?<![{_L}-])(?<![{_L}]\\.)|(?<=-)(?:(?<![{_L}]-{{1,31}})|(?=[^ \\n.]{{32}}))|(?=[^ \\n.]{{63}}\\.))"
URL = f"(?i:(?=[hw])(?:https?://|www\\.){_PATH}+|{_NAME_START}(?:{_LABEL}\\.(?=[{_L}]))++(?:{'|'.join(TLDS)})(?![{_L}-]|\\.[{_L}])(?:[/?#]{_PATH}*)?)"
#: What every link holds, found faster than a link.
IN_URL = f"[:.](?i:(?<=https?:)//|(?<=www\\.)|(?<=\\.)(?:{'|'.join(TLDS)})(?![{_L}-]|\\.[{_L}]))"
_B = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
PHONE = "(?=[+0])(?:\\+|(?<![A-Za-z0-9_])00?)[1-9](?:[ \\t/().-]{0,2}[0-9]){6,14}(?![0-9])"
IN_PHONE = "[+0][1-9](?:[ \\t/().-]{0,2}[0-9]){6}"
#: A run of characters of names is read once, from its beginning or the end of the match before.
EMAIL = "(?i:(?:\\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++@[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]{2,24})"
IBAN = f"(?i:{_B}[a-z]{{2}}[0-9]{{2}}(?: ?[a-z0-9]{{4}}){{3,7}}(?: ?[a-z0-9]{{1,3}})?{_B})"
IN_IBAN = "[0-9](?<=[A-Za-z]{2}[0-9])[0-9]"
CARD = "[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"


def is_url_start(before: Column) -> Column:
    """A link doesn't begin right after these characters."""
    return ~before.rlike("[@A-Za-z0-9_.\\-]")


def host_of(c: Column) -> Column:
    """The host of a link: behind any user part, without port, final dot and www."""
    found = F.regexp_extract(text_of(c), f"^(?i:[a-z][a-z0-9+.-]*://)?([^/?#{SPACES}]+)", 1)
    host = F.regexp_replace(F.regexp_replace(F.substring_index(found, "@", -1), ":[0-9]+(?![\\s\\S])", ""), "\\.(?![\\s\\S])", "")
    return F.regexp_replace(F.lower(host), "^www\\.", "")


def host_matches(host: Column, domains: Column) -> Column:
    """Whether a host is one of the domains or under one; leading dots and empty domains don't count."""
    h = F.lower(text_of(host))

    def one(d: Column) -> Column:
        name = F.regexp_replace(F.lower(text_of(d)), "^\\.+", "")
        return (name != "") & ((h == name) | F.endswith(h, F.concat(F.lit("."), name)))

    return F.coalesce(F.exists(domains, one), F.lit(False))


def extract_urls(c: Column) -> Column:
    """Links in order, each once (by its lower case): array of (url, host)."""
    none = F.array().cast("array<struct<url:string,host:string>>")
    return F.when(text_of(c).rlike(f"(?i)https?://|www\\.|\\.(?:{'|'.join(TLDS)})(?![a-z0-9])"), _urls(c)).otherwise(none)


def _urls(c: Column) -> Column:
    found = matches(text_of(c), URL, is_url_start)
    urls = F.transform(found, lambda u: F.regexp_replace(u, "[.,;:!?'\"]+(?![\\s\\S])", ""))
    both = F.filter(F.transform(urls, lambda u: F.struct(u.alias("url"), host_of(u).alias("host"))), lambda x: x["host"] != "")

    def first(all_: Column) -> Column:
        keys = F.transform(all_, lambda x: F.lower(x["url"]))
        return let(keys, lambda ks: F.filter(all_, lambda x, k: F.array_position(ks, F.lower(x["url"])) == k + 1))

    return let(both, first)


def count_digits(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, "[^0-9]", ""))


def is_phone(m: Column) -> Column:
    """Nine to fifteen digits, and no date."""
    return count_digits(m).between(9, 15) & ~m.rlike("^[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{2,4}")


def is_iban(m: Column) -> Column:
    return count_digits(m) >= 10


def extract_ibans(c: Column) -> Column:
    return F.filter(matches(text_of(c), IBAN), is_iban)


def extract_phones(c: Column) -> Column:
    s = replace_each(text_of(c), IBAN, lambda m, _: F.when(is_iban(m), F.lit(" ")).otherwise(m), IN_IBAN)
    some = text_of(c).rlike(IN_PHONE)
    return F.when(some, F.transform(F.filter(matches(s, PHONE), is_phone), trim)).otherwise(F.array().cast("array<string>"))


#: Signs of an address in words; white space and words before them are read once, from their beginning or the end of the match before.
_WHITE_BEFORE = f"(?:\\G|(?<![{SPACES}]))[{SPACES}]*+"
_AT = "(?iu)" + _WHITE_BEFORE + java(r"[(\[{]\s*(?:at|ät|@)\s*[)\]}]\s*")
_DOT = "(?iu)" + _WHITE_BEFORE + java(r"[(\[{]\s*(?:dot|punkt)\s*[)\]}]\s*")
_IN_SIGN = "[(\\[{](?iu:" + java(r"\s*(?:at|ät|@|dot|punkt)\s*[)\]}]") + ")"
_SPELLED = f"(?iu)(\\G|(?<![a-z0-9._-])[.-]*+){BOUNDARY}([a-z0-9._-]++)" + java(r"\s+(?:at|ät)\s+([a-z0-9-]+)\s+(?:dot|punkt)\s+([a-z]{2,6})\b")
_IN_SPELLED = f"[dDpP](?iu:(?<=[{SPACES}]d)ot|(?<=[{SPACES}]p)unkt)[{SPACES}]"


def deobfuscate_emails(c: Column) -> Column:
    s = where(text_of(c), lambda x: x.rlike(_IN_SIGN), lambda x: F.regexp_replace(F.regexp_replace(x, _AT, "@"), _DOT, "."))
    return where(s, lambda x: x.rlike(_IN_SPELLED), lambda x: F.regexp_replace(x, _SPELLED, "$1$2@$3.$4"))


def extract_emails(c: Column) -> Column:
    """Addresses in lower case and order, each once."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(deobfuscate_emails(c), F.lit(f"({EMAIL})"), 1), F.lower))
    some = F.contains(text_of(c), F.lit("@")) | text_of(c).rlike("(?iu)[(\\[{][^a-z]*(?:at|ät)[^a-z]*[)\\]}]|[^a-z](?:dot|punkt)[^a-z]")
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


# ------------------------------------------------------------------------------------------------- redaction

_SEP = r"(\s*(?:ist|lautet|:|=)?\s*)"
_WITH_DIGIT = r"[a-z0-9-]*\d[a-z0-9-]*"
#: Key word, separator and value of secrets in the order of application, and what stands for the value.
SECRETS = [
    (r"\b(passwort|kennwort|password|zugangsdaten)" + _SEP + r"(?:[^\s]{3,}?)(?=[.,;:!?]*(?:\s|$))", "[GEHEIM]"),
    (r"\b(cvv2?|cvc2?|kartenpr(?:ü|ue)fnummer|pr(?:ü|ue)fziffer|sicherheitscode|pin|tan|sms-?code|best(?:ä|ae)tigungs-?code|verifizierungs-?code|einmal-?code|code)" + _SEP + r"(?:[a-z0-9-]*\d{3}[a-z0-9-]*)", "[CODE]"),
    (r"\b(g(?:ü|ue)ltig bis|ablaufdatum|valid thru|exp\.?)" + _SEP + r"(?:\d{1,2}\s*\/\s*\d{2,4})\b", "[DATUM]"),
    (r"\b(bic|swift)" + _SEP + r"(?:[a-z]{6}[a-z0-9]{2}(?:[a-z0-9]{3})?)\b", "[BIC]"),
    (r"\b(kontonummer|konto-?nr\.?|kto\.?-?nr\.?|blz|bankleitzahl)" + _SEP + r"(?:\d[\d ]{3,}\d)", "[KONTO]"),
    (r"\b((?:personal)?ausweis(?:-?nummer|-?nr\.?)?|reisepass(?:-?nummer|-?nr\.?)?|pass(?:-?nummer|-?nr\.?)|f(?:ü|ue)hrerschein(?:-?nummer|-?nr\.?)?)" + _SEP + "(?:" + _WITH_DIGIT + "(?: ?" + _WITH_DIGIT + "){0,3})", "[AUSWEIS]"),
    (r"\b(sv-?nummer|sv-?nr\.?|svnr|(?:sozial)?versicherungs-?(?:nummer|nr\.?))" + _SEP + r"(?:\d[\d ]{8,12}\d)", "[SVNR]"),
    (r"\b(steuer-?id|steuer-?identifikationsnummer|steuernummer|ust-?id(?:-?nr\.?)?|uid(?:-?nr\.?)?)" + _SEP + r"(?:[a-z]{0,3}[\d\/ ]{6,}\d)", "[STEUERNR]"),
]
#: What stands in a text besides a key word where a secret of that kind is.
_IN_SECRET = {
    "[CODE]": "[0-9][0-9][0-9]", "[DATUM]": f"/[{SPACES}]*[0-9]", "[KONTO]": "[0-9][0-9 ]{3}", "[AUSWEIS]": "[0-9]", "[SVNR]": "[0-9][0-9 ]{8}", "[STEUERNR]": "[0-9](?<=[0-9/ ]{6}[0-9])",
}
_NOT_LETTER_BEFORE = "(?<![A-Za-zÄÖÜäöüß])"
_STREET = "stra(?:ß|ss)e|str\\.|gasse|weg|platz|allee|ring|damm|ufer|steig|zeile|promenade|kai|pfad|chaussee"
ADDRESS = (
    _NOT_LETTER_BEFORE + "(?:[A-ZÄÖÜ][a-zäöüß]{2,}(?:-[A-ZÄÖÜ]?[a-zäöüß]+)*(?:" + _STREET + ")|[A-ZÄÖÜ][a-zäöüß]+ (?:Stra(?:ß|ss)e|Str\\.|Gasse|Allee|Platz|Weg|Ring))"
    "\\s*\\d{1,4}\\s?[a-z]?(?![\\wäöüß])(?:\\s*\\/\\s*\\d{1,4})*(?!\\s*(?:[Mm]in(?:uten)?|[Ss]ek(?:unden)?|[Ss]td|[Ss]tunden|km|m|[Mm]eter|[Mm]al|[Ss]tück|[Ee]uro|€)(?![a-zäöüß]))"
)
BIRTHDATE = r"\b(geb\.|geboren(?: am)?|geburtsdatum|geb\.?-?datum|geburtstag)(\s*(?:ist|am|:)?\s*)\d{1,2}\.\s?\d{1,2}\.\s?\d{2,4}\b"
HANDLE = f"@(?<![^{SPACES}(„\"']@)(?iu:[a-z0-9_.]{{3,30}}{BOUNDARY})"
_NAME_WORD = "[A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)?"
_NAMES = _NAME_WORD + "(?: " + _NAME_WORD + "){0,2}"
INTRO = "((?:[Mm]ein [Nn]ame ist|[Ii]ch hei(?:ß|ss)e)\\s+)" + _NAMES
SIGNOFF = (
    "((?:^|\\n)[ \\t]*(?:(?:[Vv]iele|[Ll]iebe|[Bb]este|[Ff]reundliche|[Hh]erzliche|[Mm]it freundlichen) )?"
    "(?:[Gg]r(?:ü|ue|u)(?:ß|ss)e?|LG|VG|MfG|GLG|BG|lg|vg|mfg)[,.!]?(?:[ \\t]*\\n[ \\t]*|[ \\t]+))" + _NAMES + "(?=[ \\t]*(?:\\n|$))"
)


def redact_cards(c: Column) -> Column:
    def one(m: Column, before: Column) -> Column:
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.when(before.rlike("[0-9+]") | F.startswith(digits, F.lit("0")) | ~F.call_function("luhn_check", digits), m).otherwise(F.lit("[KARTENNUMMER]"))

    return replace_each(text_of(c), CARD, one)


def redact_secrets(c: Column) -> Column:
    """Bank, card, access and identity data replaced by what they are; key words stay.

    A pattern runs only where the text holds a key word of it and digits as it needs them; marks put in by earlier patterns hold
    none of later ones. Where a key word is, a text's own U+0001 and U+0002 go.
    """
    marks = f"[{OPEN}{CLOSE}]"

    def one(s: Column, pattern: str, name: str) -> Column:
        # a missing separator becomes a blank
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, keyed(pattern), f"$1{OPEN}$2{CLOSE}{name}"), f"{OPEN}{CLOSE}", " "), marks, "")

    def some(v: Column, s: Column, pattern: str, name: str) -> Column:
        words = [F.contains(v["low"], F.lit(w)) for w in sorted(literals(pattern, 3) or literals(pattern, 2))]
        word = reduce(Column.__or__, words)
        return v["digits"] & word & s.rlike(f"{_IN_SECRET[name]}|{marks}") if name in _IN_SECRET else word

    def all_of(v: Column) -> Column:
        s = where(v["text"], lambda _: v["digits"], lambda x: redact_cards(replace_each(x, IBAN, lambda m, _: F.when(is_iban(m), F.lit("[IBAN]")).otherwise(m), IN_IBAN)))
        for pattern, name in SECRETS:
            s = where(s, partial(some, v, pattern=pattern, name=name), partial(one, pattern=pattern, name=name))
        return s

    low = F.replace(F.lower(text_of(c)), F.lit("ſ"), F.lit("s"))
    return let(F.struct(text_of(c).alias("text"), low.alias("low"), text_of(c).rlike(f"[0-9]|{marks}").alias("digits")), all_of)


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, "([.*+?^\\$\\{\\}()|\\[\\]\\\\])", "\\\\\\\\$1")


def redact_names(c: Column, names: Column | None = None) -> Column:
    """Introductions, sign-offs, and the given names with their parts of three letters or more, longest first."""
    introduced = lambda s: F.contains(s, F.lit("ame ist")) | F.contains(s, F.lit("ch heiße")) | F.contains(s, F.lit("ch heisse"))
    s = F.regexp_replace(where(text_of(c), introduced, lambda x: F.regexp_replace(x, java(INTRO), "$1[NAME]")), java(SIGNOFF), "$1[NAME]")
    if names is None:
        return s
    has_letter = lambda p: p.rlike("[A-Za-zÄÖÜäöüß]")
    every = F.flatten(F.transform(F.filter(names, lambda n: text_of(n) != ""), lambda n: F.concat(
        F.filter(F.array(trim(n)), lambda x: (F.char_length(x) >= 2) & has_letter(x)), F.filter(F.split(trim(n), f"[{SPACES}_.-]+"), lambda p: (F.char_length(p) >= 3) & has_letter(p)))))
    known = F.transform(F.array_sort(F.transform(every, lambda n, k: F.struct((-F.char_length(n)).alias("l"), k.alias("k"), n.alias("n")))), lambda x: x["n"])
    return F.aggregate(known, s, lambda t, n: F.regexp_replace(t, F.concat(F.lit(_NOT_LETTER_BEFORE), _quoted(n), F.lit("(?![A-Za-zÄÖÜäöüß0-9_])")), F.lit("[NAME]")))


def redact_pii(c: Column, names: Column | None = None) -> Column:
    """Personal data replaced by what they are, in a fixed order."""
    at = lambda s: F.contains(s, F.lit("@"))
    s = where(deobfuscate_emails(redact_secrets(c)), at, lambda x: F.regexp_replace(x, EMAIL, "[E-MAIL]"))
    s = replace_each(s, URL, lambda m, b: F.when(is_url_start(b), F.concat(F.lit("[LINK: "), host_of(m), F.lit("]"))).otherwise(m), IN_URL)
    s = replace_each(s, PHONE, lambda m, _: F.when(is_phone(m), F.lit("[TELEFONNUMMER]")).otherwise(m), IN_PHONE)
    s = where(s, at, lambda x: F.regexp_replace(x, HANDLE, "[BENUTZERNAME]"))

    def places_and_dates(x: Column) -> Column:
        x = F.regexp_replace(x, java(ADDRESS), "[ADRESSE]")
        x = F.regexp_replace(x, java(r"(\[ADRESSE\],?\s*)(?:[A-Z]{1,2}-)?\d{4,5}\b"), "$1[PLZ]")
        x = F.regexp_replace(x, keyed(r"\b(plz|postleitzahl)" + _SEP + r"\d{4,5}\b"), "$1$2[PLZ]")
        return F.regexp_replace(x, keyed(BIRTHDATE), "$1$2[GEBURTSDATUM]")

    return redact_names(where(s, lambda x: x.rlike("[0-9]"), places_and_dates), names)


def defang_urls(c: Column, allowed: Column) -> Column:
    """Links to other than the allowed domains made unclickable."""

    def one(m: Column, before: Column) -> Column:
        return F.when(~is_url_start(before) | host_matches(host_of(m), allowed), m).otherwise(F.replace(F.regexp_replace(m, "(?i)^http", "hxxp"), F.lit("."), F.lit("[.]")))

    return replace_each(text_of(c), URL, one, IN_URL)


# ------------------------------------------------------------------------------------------------- formatting


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def truncate(c: Column, limit: int) -> Column:
    """At most `limit` UTF-16 units, cut at a blank in the last fifth, with an ellipsis."""

    def short(s: Column) -> Column:
        if limit <= 1:
            return F.substring(s, 1, max(0, limit))
        units = F.substring(F.encode(s, "UTF-16BE"), 1, 2 * (limit - 1))
        half = F.hex(F.substring(units, 2 * (limit - 1) - 1, 1)).between("D8", "DB")  # half of a pair at the end goes
        plain = F.decode(F.when(half, F.substring(units, 1, 2 * (limit - 2))).otherwise(units), "UTF-16BE")
        at_blank = lambda p: let(F.regexp_extract(p, "^([\\s\\S]*) [^ ]*$", 1), lambda cut: F.when(F.contains(p, F.lit(" ")) & (utf16_length(cut) > limit * 0.8), cut).otherwise(p))
        return F.concat(F.regexp_replace(let(plain, at_blank), f"[{SPACES}]+(?![\\s\\S])", ""), F.lit("…"))

    return let(text_of(c), lambda s: F.when(utf16_length(s) <= limit, s).otherwise(short(s)))


def one_line(c: Column, limit: int) -> Column:
    return truncate(trim(F.regexp_replace(text_of(c), f"[{SPACES}]+", " ")), limit)


def parse_number(c: Column) -> Column:
    """The first number of a text, German or English; null if there is none."""
    s = F.regexp_extract(text_of(c), f"[0-9][0-9.,{SPACES}]*", 0)
    s = F.regexp_replace(F.regexp_replace(s, f"[{SPACES}]", ""), "[.,]+$", "")

    def plain(x: Column) -> Column:
        german, english = x.rlike("^[0-9]{1,3}(\\.[0-9]{3})+(,[0-9]+)?$"), x.rlike("^[0-9]{1,3}(,[0-9]{3})+(\\.[0-9]+)?$")
        return F.when(german, F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(english, F.replace(x, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(x, "^([^,]*),", "$1."))

    return F.regexp_extract(let(s, plain), "^[0-9]+(?:\\.[0-9]+)?", 0).try_cast("double")


def round_cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def format_euro(c: Column) -> Column:
    s = F.translate(F.format_number(round_cents(c), 2), ",.", ".,")
    return F.concat(F.regexp_replace(s, ",00$", ""), F.lit(" €"))


def short_model(c: Column) -> Column:
    return F.regexp_replace(F.substring_index(text_of(c), "/", -1), ":free$", "")


def redact_log(c: Column, secrets: list[str] = ()) -> Column:
    """Log lines without registered secrets (of eight characters or more), bot tokens and keys."""
    s = text_of(c)
    for secret in secrets:
        if len(secret) >= 8:
            s = F.replace(s, F.lit(secret), F.lit("***"))
    s = F.regexp_replace(s, "bot[0-9]{5,}:[A-Za-z0-9_-]{20,}", "bot***")
    return F.regexp_replace(s, "sk-or-[A-Za-z0-9_-]{10,}", "sk-or-***")
