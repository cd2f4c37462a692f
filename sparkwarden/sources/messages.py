"""Where messages come from: threads, candidates for a run, and small tables of a model service."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from sparkwarden.functions import text as T
from sparkwarden.functions.regex import java

MAIL = Y.StructType([Y.StructField(n, Y.TimestampType() if n == "received_at" else Y.StringType()) for n in ("id", "thread_id", "subject", "sender", "reply_to", "received_at", "plain_body", "html_body", "permalink")])


def explode_threads(threads: DataFrame) -> DataFrame:
    """Threads (thread_id, messages array<struct>) as one row a message."""
    return threads.select("thread_id", F.explode("messages").alias("m")).select("thread_id", "m.*")


def to_input(df: DataFrame) -> DataFrame:
    """Mails with empty texts for nulls; the HTML is kept only where the plain body has under 20 characters."""
    short = T.utf16_length(T.trim(T.text_of(F.col("plain_body")))) < 20
    out = {c: T.text_of(F.col(c)) for c in ("subject", "sender", "reply_to", "plain_body", "permalink")}
    return df.withColumns(out | {"html_body": F.when(short, T.text_of(F.col("html_body"))).otherwise("")})


def newer_than(df: DataFrame, time: str, days: int, now: Column) -> DataFrame:
    return df.where(F.col(time) > now - F.expr(f"interval {days} days"))


def wanted(df: DataFrame, domains: Sequence[str], now: Column, days: int, subject: str = "", unread: str | None = None, subject_domains: Sequence[str] = ()) -> DataFrame:
    """Mails of the last `days` from addresses under one of the domains, and unread (if asked).

    `subject` is a condition on those from subject_domains, or, if there are none, on all. Without any domains all senders count.
    """
    address = F.regexp_extract(F.lower(T.text_of(F.col("sender"))), "@([a-z0-9.-]+)", 1)
    under = lambda names: T.host_matches(address, F.array(*map(F.lit, names)).cast("array<string>"))
    fits = T.text_of(F.col("subject")).rlike(java(subject, "i")) if subject else F.lit(True)
    if subject_domains:
        keep = (under(subject_domains) & fits) | (under(domains) if domains else F.lit(False))
    else:
        keep = (under(domains) if domains else F.lit(True)) & fits
    return newer_than(df, "received_at", days, now).where(keep & (F.col(unread) if unread else F.lit(True)))


def candidates(df: DataFrame, done: DataFrame, limit: int, key: str = "id", time: str = "received_at") -> DataFrame:
    """Rows that aren't done: the `limit` newest, oldest first. `done` is anti-joined, so the limit doesn't count done rows."""
    fresh = df.join(done.select(key).distinct(), key, "left_anti")
    return fresh.orderBy(F.desc(time), F.desc(key)).limit(limit).orderBy(time, key)


def paged_candidates(df: DataFrame, done: DataFrame, page: int, pages: int = 3, thread: str = "thread_id", key: str = "id", time: str = "received_at") -> DataFrame:
    """Open rows of the first page of threads (newest first) that has any; at most `pages` pages of `page` threads are looked at.

    Threads of a page are few, so all that is ranked is the newest `page * pages` of them.
    """
    newest = df.groupBy(thread).agg(F.max(time).alias("_newest")).orderBy(F.desc("_newest"), F.desc(thread)).limit(page * pages)
    ranked = newest.withColumn("_page", F.floor((F.row_number().over(Window.orderBy(F.desc("_newest"), F.desc(thread))) - 1) / page))
    open_ = df.join(F.broadcast(ranked.select(thread, "_page")), thread).join(done.select(key).distinct(), key, "left_anti")
    first = open_.agg(F.min("_page").alias("_first"))
    return open_.join(F.broadcast(first), F.col("_page") == F.col("_first")).drop("_page", "_first").orderBy(time, key)


def latest(df: DataFrame, key: str = "id", time: str = "received_at") -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(key)).limit(1)


def chats(updates: DataFrame) -> DataFrame:
    """Distinct chats (chat_id, title) of updates (seq, message, channel_post, edited_message, my_chat_member structs); the last title wins."""
    chat = F.coalesce("message", "channel_post", "edited_message", "my_chat_member")
    return updates.select("seq", chat.alias("c")).where("c.chat_id is not null").groupBy("c.chat_id").agg(F.max_by("c.title", "seq").alias("title"))


def free_models(models: DataFrame, zdr: DataFrame | None = None) -> DataFrame:
    """Models (id, context, prompt_price, completion_price, outputs, parameters) that cost nothing and write text; zdr is null if its list is missing."""
    free = F.col("id").rlike(":free$") | ((F.col("prompt_price") == 0) & (F.col("completion_price") == 0))
    text = F.col("outputs").isNull() | F.array_contains("outputs", "text")
    json = F.coalesce(F.arrays_overlap("parameters", F.array(F.lit("response_format"), F.lit("structured_outputs"))), F.lit(False))
    out = models.where(free & text).select("id", "context", json.alias("json_mode"))
    if zdr is None:
        return out.withColumn("zdr", F.lit(None).cast("boolean"))
    ids = zdr.where("model_id is not null").select(F.col("model_id").alias("id")).distinct().withColumn("zdr", F.lit(True))
    return out.join(ids, "id", "left").withColumn("zdr", F.coalesce("zdr", F.lit(False))).orderBy(F.desc("zdr"), "id")


def keep_last(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n entries added last, each key once."""
    once = df.groupBy(key).agg(F.max(order).alias(order))
    return once.orderBy(F.desc(order), F.desc(key)).limit(n)
