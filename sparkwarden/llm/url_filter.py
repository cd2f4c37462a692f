"""URL rules behind a blocked Bloom filter, in DataFrame operations only.

A rule is a host and the start of a path; listed in canonical form it is one key, `host` and `path` joined. A URL can only fit keys made
of the ends of its host and the starts of its path, in the shapes (labels of the host, length of the path) that some rule has. A filter
of all listed keys, in blocks of 64 bits of which a key sets up to four bits of one, is asked for these few: URLs none of whose keys may
be listed are done without a shuffle. The others meet the list by an exact hash join, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm._shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Bits a key; blocks at least and at most (2^20 of 64 bits: 8 MB). A filter that is full sorts out less, and loses nothing.
BITS, FEWEST, MOST = 16, 64, 1 << 20
#: Keys of a URL that the filter is asked for while its row stays whole; a URL with more keys counts as a possible hit.
PROBES = 16
#: A list of at most so many rules and characters is broadcast; a longer one is shuffled, but for the keys with so many rows.
FEW_RULES, FEW_CHARS, HEAVY_ROWS = 100_000, 16_000_000, 1_000_000
RULE = "host string, path string, verdict string"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased) and path (then up to `?`, `#` or the end); else empty."""
    text, shape = F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, shape, 1), UPPER, LOWER), F.regexp_extract(text, shape, 2)


def _labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1


def canonical(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) as key, labels, length, verdict: each key once (block wins), without rules that no URL can fit."""
    host = F.translate("host", UPPER, LOWER)
    usable = rules.where("host is not null and path is not null and verdict in ('allow', 'block') and (path = '' or startswith(path, '/')) and host not rlike '[/?#]' and path not rlike '[?#]'")
    shaped = usable.select(F.concat(host, "path").alias("key"), _labels(host).alias("labels"), F.char_length("path").alias("length"), "verdict")
    return shaped.groupBy("key", "labels", "length").agg(F.max("verdict").alias("rule_verdict"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 32), F.lit(blocks)).cast("int")


def _bits(key: Column) -> Column:
    """The bits that a key sets in its block: four picks of six bits of its hash."""
    picks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key), 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return picks[0].bitwiseOR(picks[1]).bitwiseOR(picks[2]).bitwiseOR(picks[3])


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """One row: `bits`, the 64-bit blocks of a filter of the column `key`. Its size is bounded by MOST."""
    spark = keys.sparkSession
    full = keys.select(_block(F.col("key"), blocks).alias("block"), _bits(F.col("key")).alias("word"))
    none = spark.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("long").alias("word"))
    words = full.unionByName(none).groupBy("block").agg(F.bit_or("word").alias("word"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "word"))), lambda x: x["word"]).alias("bits"))


def _maybe(key: Column, bits: Column, blocks: int) -> Column:
    """Whether a key may be listed; false only if it surely isn't."""
    return F.get(bits, _block(key, blocks)).bitwiseAND(_bits(key)) == _bits(key)


def _listed(hits: DataFrame, listed: DataFrame, few: bool) -> DataFrame:
    """Possible hits (key and what belongs to them) with rule_verdict where the key is listed: an exact hash join.

    A long list is shuffled; keys of HEAVY_ROWS possible hits or more, of which there is one for that many rows at most, are broadcast.
    """
    if few:
        return hits.join(F.broadcast(listed), "key", "left")
    hits = stored(hits, "url-hits")
    heavy = stored(hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEAVY_ROWS).select("key"), "url-heavy")
    rest = hits.join(F.broadcast(heavy), "key", "left_anti").join(listed, "key", "left")
    return hits.join(F.broadcast(heavy.join(listed, "key", "left")), "key").unionByName(rest)


def judge(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of df: `id_col`, host, path, rule (the longest that fits, as host and path joined, or null), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; URLs that no rule fits get `default`. Of rules of
    equal text block wins; rules with a null, an unknown verdict or a text that no URL can have are passed over. Null URLs and URLs
    without `://` have an empty host and path, and repeated rows, null ids included, come out as often as they come in. Only the two
    named columns of df are read.
    """
    spark = df.sparkSession
    listed = stored(canonical(rules), "url-rules")
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length("key")), F.lit(0)).alias("chars"), F.collect_set(F.struct("labels", "length")).alias("shapes")).first()
    host, path = parts(F.col(url_col))
    # what inline() gives is made once for a row; a mere column would be made anew at each place that names it
    pages = df.select(F.col(id_col).alias("_sw_id"), F.inline(F.array(F.struct(host.alias("host"), path.alias("path")))))
    if not size["n"]:
        return pages.select(F.col("_sw_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = min(MOST, max(FEWEST, 1 << (size["n"] * BITS // 64).bit_length()))
    bits = stored(bloom(listed, blocks), "url-filter").scalar()
    shapes = F.array(*[F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["length"]).alias("length")) for s in sorted(size["shapes"])])
    fitting = "transform(filter(_sw_shapes, s -> s.labels <= _sw_labels and s.length <= length(path)), s -> concat(substring_index(host, '.', -s.labels), left(path, s.length)))"
    asked = pages.withColumns({"_sw_shapes": shapes, "_sw_labels": _labels(F.col("host"))}).select("_sw_id", "host", "path", F.inline(F.array(F.struct(F.expr(fitting).alias("_sw_keys")))))
    n = F.size("_sw_keys")
    some = n > PROBES
    for k in range(min(PROBES, len(size["shapes"]))):
        some = some | ((n > k) & _maybe(F.get("_sw_keys", F.lit(k)), bits, blocks))
    asked = asked.withColumn("_sw_some", F.coalesce(some, F.lit(False)))
    sure = asked.where("not _sw_some").select(F.col("_sw_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    each = asked.where("_sw_some").select("_sw_id", "host", "path", F.posexplode("_sw_keys").alias("_sw_at", "key"))
    hits = each.where((F.col("_sw_at") == 0) | _maybe(F.col("key"), bits, blocks))  # the first key stands for its row, whatever fits
    few = size["n"] <= FEW_RULES and size["chars"] <= FEW_CHARS
    met = _listed(hits, listed.select("key", "labels", "rule_verdict"), few)
    rank = F.when(F.col("rule_verdict").isNotNull(), F.struct(F.char_length("key"), "labels"))
    best = met.groupBy("_sw_id", "host", "path").agg(F.max_by(F.struct("key", "rule_verdict"), rank).alias("_sw_best"), F.count_if(F.col("_sw_at") == 0).alias("_sw_n"))
    found = best.select("_sw_id", "host", "path", "_sw_best", F.explode(F.expr("sequence(1, _sw_n)")))
    out = found.select(F.col("_sw_id").alias(id_col), "host", "path", F.col("_sw_best.key").alias("rule"), F.coalesce("_sw_best.rule_verdict", F.lit(default)).alias("verdict"))
    return sure.unionByName(out)


def rules_of(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Rules as a table for judge."""
    each = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*each)))


def brute_force(urls: list[str | None], rules: tuple[tuple[str, str, str], ...], default: str = "allow") -> list[tuple[str, str, str | None, str]]:
    """What judge gives for each URL, rule by rule."""
    out = []
    for url in urls:
        rest = (url or "").partition("://")[2]
        host = rest[: min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))]
        path = rest[len(host) :]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(p), h.count("."), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default))
    return out


def _oracle() -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH rules(h, p, v) AS (VALUES {rows}),
u AS (
  SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
best AS (
  SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (k)
"""


ORACLE = _oracle()
