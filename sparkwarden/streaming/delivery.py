"""Deliver each message once: an outbox of mails, intents and outcomes, bounded attempts, a throttle for alerts and a cool-down.

What arrives is first offered to the outbox; each run takes the oldest open mails of it and admits them one by one, each with the
answer of its language model, as long as there is time for one more; at least one is admitted. They are analysed together, then sent. Right before a send its intent is written, right after it the outcome, each as a version of the
same record set (see store.py), so a run that dies leaves one mail at most of which it isn't known whether it was sent. Such a mail
isn't sent again by itself: the next run reports it as uncertain. Mails beyond a run's limits, and failed ones below
max_delivery_attempts, stay open and are offered again by the next run, whether or not new mails arrive.
"""

from __future__ import annotations

import json
import logging
import random
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkwarden.plans.config import Settings
from sparkwarden.sources import mailbox, messages
from sparkwarden.streaming.store import Fenced, Head, Lease, RecordLog

log = logging.getLogger("sparkwarden")
#: Shortest and longest pause in seconds; seconds that a message needs; ids and attempts that an outbox keeps at least.
PAUSE, RESERVE, KEEP_DONE, KEEP_ATTEMPTS = (60, 6 * 3600), 75, 400, 100
#: Parts and noted records after which an outbox is merged.
PARTS, RECORDS = 16, 200
MAIL = messages.MAIL.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
#: Statuses after which a mail is done.
ENDED = ("sent", "skipped", "uncertain", "given up")


class FatalError(RuntimeError):
    """Stops the run: the channel refuses everything."""


@dataclass
class Timers:
    """Entries that end by themselves: the throttle's keys and the cool-down, each with a reason. With `keep` they outlive the process."""

    until: dict[str, float] = field(default_factory=dict)
    clock: Callable[[], float] = time.time
    why: dict[str, str] = field(default_factory=dict)
    keep: Callable[[dict[str, list]], None] | None = None

    def load(self, kept: dict[str, list]) -> None:
        self.until |= {k: v[0] for k, v in kept.items()}
        self.why |= {k: v[1] for k, v in kept.items()}

    def _changed(self, key: str) -> None:
        if self.keep:
            self.keep({key: [self.until.get(key, 0.0), self.why.get(key, "")]})

    def start(self, key: str, seconds: float, why: str = "") -> None:
        self.until[key] = self.clock() + min(max(seconds, PAUSE[0]), PAUSE[1])
        self.why[key] = why
        self._changed(key)

    def end(self, key: str) -> None:
        if self.until.pop(key, None) is not None:
            self._changed(key)

    def running(self, key: str) -> bool:
        if self.until.get(key, 0) <= self.clock():
            self.until.pop(key, None)
            return False
        return True

    def allow(self, key: str, seconds: float) -> bool:
        """Whether a throttled key may go; it is used up even if what follows fails."""
        if self.running(key):
            return False
        self.start(key, seconds)
        return True


@dataclass
class Box:
    """The outbox of one inbox in a shared folder: of each id its mail, intents, attempts and outcome, in one versioned record set."""

    spark: SparkSession
    path: str
    schema: str = MAIL
    clock: Callable[[], float] = time.time

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(",")]

    @property
    def log(self) -> RecordLog:
        inner = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in self.schema.split(","))
        return RecordLog(self.spark, self.path, f"id string, status string, attempts int, at timestamp, mail struct<{inner}>", self.clock)

    def offer(self, mails: DataFrame, stream: str | None = None, batch: int = 0) -> bool:
        """Add mails; False if this micro-batch of the stream was added before. Repeated ids count once, mails without one get one from their content."""
        records = self.log
        if stream and records.head().batches.get(stream, -1) >= batch:
            return False
        content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in self.columns if c != "id"])), 256)
        keyed = mails.select(*self.columns).withColumn("id", F.coalesce("id", F.concat(F.lit("content-"), content)))
        rows = keyed.select("id", F.lit("offered").alias("status"), F.lit(0).alias("attempts"), F.timestamp_seconds(F.lit(self.clock())).alias("at"), F.struct(*self.columns).alias("mail"))
        part = records.write_part(rows)
        added = []

        def add(head: Head) -> None:
            added[:] = [not (stream and head.batches.get(stream, -1) >= batch)]
            if added[0]:
                head.parts += [part] if part["rows"] else []
                head.batches |= {stream: batch} if stream else {}

        records.commit(add)
        return added[0]

    def take(self, path: str) -> int:
        """Add the batches that were committed to an outbox sink (sources.mailbox) and aren't here yet; how many there were."""
        return sum(self.offer(rows, f"sink-{label}", 0) for label, rows in mailbox.committed(self.spark, path, self.schema).items())

    def note(self, lease: Lease, *rows: tuple[str, str, int]) -> None:
        """Add (id, status, attempts) records: an intent, or what came of it."""

        def add(head: Head) -> None:
            for id_, status, attempts in rows:
                head.note(id_, status, attempts, self.clock())

        self.log.commit(add, lease)

    def state(self, limit: int, head: Head | None = None) -> DataFrame:
        """One row an id: id, attempts, done, doubt (an intent without an outcome), at, status (the last), mail (null if it isn't known)."""
        per = self.log.rows(head)
        is_ = lambda *s: F.count_if(F.col("status").isin(*s))
        out = per.groupBy("id").agg(
            F.sum(F.when(F.col("status").isin("failed", "open", *ENDED), F.col("attempts")).otherwise(0)).cast("int").alias("attempts"),
            (is_(*ENDED) > 0).alias("ended"), (is_("intent") > is_("failed", "released", *ENDED)).alias("doubt"),
            F.max("at").alias("at"), F.max_by("status", F.struct(F.col("status").isin(*ENDED), "at")).alias("status"), F.first("mail", ignorenulls=True).alias("mail"),
        )
        return out.select("id", "attempts", (F.col("ended") | (F.col("attempts") >= limit)).alias("done"), "doubt", "at", "status", "mail")

    def open(self, limit: int) -> DataFrame:
        """Mails that aren't done, each id once, with their attempts and whether they are in doubt."""
        rest = self.state(limit).where("not done and mail is not null")
        return rest.select("id", *[F.col(f"mail.{c}").alias(c) for c in self.columns if c != "id"], "attempts", "doubt")

    def known(self, limit: int = 1 << 30) -> DataFrame:
        return self.state(limit).select("id")

    def tidy(self, lease: Lease, cfg: Settings) -> None:
        """Merge many parts and records into one part: a row an id, the mail only while it is open, without what can't come back.

        Mails older than newer_than_days are no longer offered; those done whose mail and outcome are both of twice that age go, as a
        whole, but for the newest ones.
        """
        head = self.log.head()
        if len(head.parts) <= PARTS and len(head.records) <= RECORDS:
            return
        every = self.state(cfg.max_delivery_attempts, head)
        old = F.timestamp_seconds(F.lit(self.clock() - 2 * cfg.newer_than_days * 86400))
        received = F.col("mail.received_at") if "received_at" in self.columns else F.lit(None).cast("timestamp")
        newest = every.where("done").orderBy(F.desc("at"), "id").limit(KEEP_DONE + KEEP_ATTEMPTS).select("id", F.lit(True).alias("new"))
        kept = every.join(newest, "id", "left").where(F.expr("not done or new") | (F.col("at") >= old) | F.coalesce(received >= old, F.lit(False)))
        ended = F.col("status").isin(*ENDED)
        status = F.when(F.col("doubt"), "intent").when(ended, F.col("status")).otherwise("open")
        # of what has ended, all but the time goes
        light = F.struct(*[(F.col(f"mail.{c}") if c in ("id", "received_at") else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in self.schema.split(","))])
        mail = F.when(ended & F.col("mail").isNotNull(), light).otherwise(F.col("mail"))
        rows = kept.select("id", status.alias("status"), "attempts", "at", mail.alias("mail"))
        twice = rows.where("status = 'intent' and attempts > 0").withColumn("status", F.lit("open"))  # keeps the attempts of what is in doubt
        self.log.merge(head, rows.unionByName(twice), lease)

    def reset(self, lease: Lease | None = None) -> None:
        """Forget what was delivered and every timer: all mails that are still held in full are open again."""
        records = self.log
        full = records.rows().where(F.col("status").isin("offered", "open", "intent") & F.col("mail").isNotNull()).dropDuplicates(["id"])
        part = records.write_part(full.withColumns({"status": F.lit("offered"), "attempts": F.lit(0)}))

        def forget(head: Head) -> None:
            head.records, head.timers, head.before, head.parts = [], {}, {"parts": [], "records": []}, [part] if part["rows"] else []

        records.commit(forget, lease)

    def keep_timers(self, changed: dict[str, list]) -> None:
        """Write timers down; those that have ended go."""

        def put(head: Head) -> None:
            head.timers = {k: v for k, v in (head.timers | changed).items() if v[0] > self.clock()}

        self.log.commit(put)


def state(ledger: DataFrame, limit: int) -> DataFrame:
    """Each id's attempts and whether it is done, from a plain ledger (id, status)."""
    per = ledger.groupBy("id").agg(F.count_if(F.col("status") == "failed").alias("attempts"), F.count_if(F.col("status") != "failed").alias("ended"))
    return per.select("id", "attempts", ((F.col("ended") > 0) | (F.col("attempts") >= limit)).alias("done"))


def statistics(outcomes: DataFrame, outcome: str = "outcome") -> DataFrame:
    """How many messages had each outcome."""
    return outcomes.groupBy(F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _late(admit: object, deadline: float | None, timers: Timers) -> bool:
    return admit is None and deadline is not None and deadline - timers.clock() < RESERVE


def deliver(box: Box, lease: Lease, screen: Callable[[DataFrame], DataFrame], prepare: Callable[[DataFrame], DataFrame], send: Callable[[dict], None], cfg: Settings, timers: Timers, alert: Callable[[str, str, Exception | None], None] | None = None, after: Callable[[dict], None] | None = None, deadline: float | None = None, admit: Callable[[list[str], DataFrame], list[str]] | None = None) -> dict[str, int]:
    """One run: `screen` adds skip_reason to open mails (cheaply), `prepare` analyses those that are admitted; statistics of the run.

    The oldest come first. Sent and failed messages count towards max_messages_per_run, skipped and uncertain ones don't; the rest is
    deferred and stays open. `admit` says for which of the due ids there is time, and may ask models meanwhile; without it all are
    admitted, and each needs RESERVE seconds when its turn comes. `after` does what follows a send (marking, a draft); its failures are logged only.
    """
    for lost in box.log.repair(lease):
        log.error("%d offered mails can't be read and have to be offered again", lost["rows"])
        if alert:
            alert("state", f"{lost['rows']} offered mails were lost with a broken part", None)
    open_ = box.open(cfg.max_delivery_attempts).persist()
    doubtful = [r["id"] for r in open_.where("doubt").select("id").collect()]  # one for each run that died
    if doubtful:
        box.note(lease, *[(i, "uncertain", 0) for i in doubtful])
        for i in doubtful:
            log.error("it isn't known whether %s was sent", i)
            if alert:
                alert(f"uncertain-{i}", f"a run ended while it sent {i}; look whether it arrived", None)
    counts = Observation("run")
    seen = screen(open_.where("not doubt").drop("doubt")).select("id", "received_at", "skip_reason", "attempts")
    seen = seen.observe(counts, F.count(F.lit(1)).alias("candidates"), F.count("skip_reason").alias("skipped")).persist()
    due = seen.where("skip_reason is null").orderBy(F.asc_nulls_first("received_at"), "id").limit(cfg.max_messages_per_run).collect()  # a few rows
    stats = dict(candidates=counts.get["candidates"], sent=0, skipped=counts.get["skipped"], failed=0, deferred=0)
    if stats["skipped"]:
        skipped = seen.where("skip_reason is not null").select("id", F.lit("skipped").alias("status"), F.lit(0).alias("attempts"), F.timestamp_seconds(F.lit(box.clock())).alias("at"))
        part = box.log.write_part(skipped)
        box.log.commit(lambda head: head.parts.append(part), lease)
    tried = 0
    of = lambda ids: open_.where(F.col("id").isin(ids)).drop("attempts", "doubt")
    every = [d["id"] for d in due]
    admitted = admit(every, of(every)) if admit and due else every
    ready: dict[str, dict] = {}
    if admitted and not _late(admit, deadline, timers):
        ready = {r["id"]: r.asDict(recursive=True) for r in prepare(of(admitted)).collect()}
    for d in due[: len(admitted)]:
        if _late(admit, deadline, timers):
            break
        tried += 1
        id_, attempts = d["id"], d["attempts"] + 1
        began = False
        try:
            row = ready.get(id_)
            if row is None:
                raise RuntimeError("the analysis gave no result")
            box.note(lease, (id_, "intent", 0))
            began = True
            send(row)
        except Fenced:
            raise
        except FatalError:
            if began:
                box.note(lease, (id_, "released", 0))
            raise
        except Exception as e:  # noqa: BLE001
            stats["failed"] += 1
            given_up = [(id_, "given up", 0)] if attempts >= cfg.max_delivery_attempts else []
            box.note(lease, *([] if began else [(id_, "intent", 0)]), (id_, "failed", 1), *given_up)
            log.warning("delivery failed (%s, attempt %d of %d): %s", id_, attempts, cfg.max_delivery_attempts, e)
            if attempts >= cfg.max_delivery_attempts and alert and timers.allow(f"giveup-{id_}", cfg.alert_throttle_minutes * 60):
                alert(f"giveup-{id_}", f"given up after {attempts} attempts: {id_}", e)
            continue
        box.note(lease, (id_, "sent", 0))
        stats["sent"] += 1
        if after:
            try:
                after(row)
            except Exception as e:  # noqa: BLE001
                log.warning("after the delivery of %s: %s", id_, e)
    stats["deferred"] = stats["candidates"] - stats["skipped"] - tried
    seen.unpersist()
    open_.unpersist()
    box.tidy(lease, cfg)
    log.info("%s", stats)
    return stats


def collect(stream: DataFrame, box: Box, checkpoint: str, cfg: Settings, run: Callable[[], object] | None = None, available_now: bool = False) -> StreamingQuery:
    """Offer a stream of mails to the outbox, each micro-batch once even if it is repeated, and call `run` after each.

    Only a run delivers; as a stream without new mails calls nothing, `serve` (or any scheduler) has to call runs besides.
    """
    name = f"{zlib.crc32(checkpoint.encode()):08x}"

    def each(batch: DataFrame, number: int) -> None:
        box.offer(batch, name, number)
        if run:
            run()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{cfg.trigger_minutes} minutes")).start()


def serve(run: Callable[[], dict | None], cfg: Settings, runs: int | None = None, sleep: Callable[[float], None] = time.sleep) -> list[dict | None]:
    """Call `run` every trigger_minutes, `runs` times or for ever; what it returned."""
    out: list[dict | None] = []
    while runs is None or len(out) < runs:
        if out:
            sleep(cfg.trigger_minutes * 60)
        out.append(run())
        if runs is None:
            out = out[-1:]
    return out


@dataclass
class Response:
    """What a transport gives back."""

    status: int
    text: str = ""
    headers: dict[str, str] = field(default_factory=dict)

    @property
    def json(self):
        try:
            return json.loads(self.text)
        except ValueError:
            return None


#: A transport takes method, url, headers and a JSON body (or None), and returns a Response; it raises OSError if the network fails.
Transport = Callable[[str, str, dict, object], Response]
#: Statuses worth another try, seconds of the first and longest wait, the longest wait that a server may ask for, and seconds kept in reserve.
RETRY_ON, FIRST_WAIT, LONGEST_WAIT, LONGEST_ASKED, LEFT_OVER = (429, 500, 502, 503, 504), 1.0, 16.0, 30.0, 10.0


def asked_wait(response: Response | None, now: float) -> float:
    """Seconds that a response's Retry-After asks for, as a number or a date; 0 if it doesn't."""
    value = {k.lower(): v for k, v in (response.headers if response else {}).items()}.get("retry-after")
    if not value:
        return 0.0
    try:
        seconds = float(value)
    except ValueError:
        try:
            seconds = parsedate_to_datetime(value).timestamp() - now
        except (TypeError, ValueError):
            return 0.0
    return min(max(0.0, seconds), LONGEST_ASKED)


def request(transport: Transport, method: str, url: str, headers: dict | None = None, body: object = None, retries: int = 2, retry_on: tuple[int, ...] = RETRY_ON, deadline: float | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> Response:
    """A response, after more tries on busy servers and network failures: waits of 1, 2, 4 ... s and a little, or as long as asked."""
    for attempt in range(retries + 1):
        failure, response = None, None
        try:
            response = transport(method, url, headers or {}, body)
        except OSError as e:
            failure = e
        if response is not None and response.status not in retry_on:
            return response
        wait = asked_wait(response, clock()) or min(LONGEST_WAIT, FIRST_WAIT * 2**attempt) + 0.5 * jitter()
        if attempt == retries or deadline is not None and deadline - clock() < wait + LEFT_OVER:
            if failure is not None:
                raise failure
            return response
        sleep(wait)
    raise AssertionError
