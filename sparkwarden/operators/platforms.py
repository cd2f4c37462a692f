"""Which platform a mail is from, by a join with a table of platforms: a change of platforms is a change of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import text as T
from sparkwarden.plans.catalog import PLATFORMS, Platform

#: A row for each sender domain; platforms are tried by rank.
PLATFORM = "rank int, id string, domain string"


def platform_table(spark: SparkSession, platforms: Sequence[Platform] = PLATFORMS) -> DataFrame:
    """The catalog's platforms as such a table."""
    rows = [F.struct(F.lit(k).alias("rank"), F.lit(p.id).alias("id"), F.lit(d).alias("domain")) for k, p in enumerate(platforms) for d in p.sender_domains]
    return spark.range(1).select(F.inline(F.array(*rows)))


def ends(host: Column) -> Column:
    """A host and all its parents: a.b.c, b.c, c."""
    labels = F.size(F.split(host, "\\."))
    return F.transform(F.sequence(F.lit(1), labels), lambda k: F.call_function("substring_index", host, F.lit("."), -k))


def with_platform(df: DataFrame, table: DataFrame, default: str = PLATFORMS[-1].id, sender: str = "sender", reply_to: str = "reply_to", out: str = "platform") -> DataFrame:
    """df with the id of the platform of lowest rank one of whose domains an address is under, else `default`.

    Each different list of domains is looked up once: its domains' ends meet the table by an equi-join. The few answers come back by a
    second join; lists that hold most mails (one platform's) are no problem, as they are one row there. Nulls are empty; leading dots in
    the table don't count, nor do its rows with a null or an empty domain; of a rank's ties the smaller id counts.
    """
    found = F.regexp_extract_all(F.lower(F.concat_ws(" ", T.text_of(F.col(sender)), T.text_of(F.col(reply_to)))), F.lit("@([a-z0-9.-]+)"), 1)
    marked = df.withColumn("_sw_hosts", F.array_join(F.array_sort(F.array_distinct(found)), " "))
    known = table.select("rank", "id", F.regexp_replace(F.lower("domain"), "^\\.+", "").alias("_sw_end")).where("_sw_end != '' and id is not null and rank is not null")
    lists = marked.select("_sw_hosts").distinct()
    each = lists.select("_sw_hosts", F.explode(F.split("_sw_hosts", " ")).alias("host")).select("_sw_hosts", F.explode(F.array_distinct(ends(F.col("host")))).alias("_sw_end"))
    answers = each.join(known, "_sw_end").groupBy("_sw_hosts").agg(F.min(F.struct("rank", "id"))["id"].alias("_sw_platform"))
    rest = [F.col(f"m.`{c}`") for c in df.columns if c != out]
    return marked.alias("m").join(answers.alias("a"), "_sw_hosts", "left").select(*rest, F.coalesce(F.col("a._sw_platform"), F.lit(default)).alias(out))
