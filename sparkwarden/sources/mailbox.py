"""A mailbox as a Spark data source, and an outbox as a sink: `sparkwarden_mailbox` and `sparkwarden_outbox`.

The mailbox's own search is an argument (`client`, as "module:function"): it is asked for pages of threads, newest first, with the
conditions that Spark pushes down (age, unread) and those of the options (senders, subjects). A read stops after the first page that is
short or has a new message. As a stream, offsets are times and ids of messages. The sink stages each task's rows in a file of its own;
only a commit of the whole micro-batch makes them count, so a task that fails leaves nothing behind that could be delivered.
"""

from __future__ import annotations

import importlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from typing import Protocol

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, SimpleDataSourceStreamReader, WriterCommitMessage

from sparkwarden.plans.config import Settings
from sparkwarden.sources.messages import MAIL

MAILBOX = Y.StructType([*MAIL.fields, Y.StructField("unread", Y.BooleanType())])
#: Pages of a search that are looked at, at most.
PAGES = 3


@dataclass(frozen=True)
class Query:
    """What a search asks for; None or empty: all. Times are aware and in UTC."""

    newer: datetime | None = None
    unread: bool | None = None
    domains: tuple[str, ...] = ()
    subject_domains: tuple[str, ...] = ()
    subject: str = ""
    present: tuple[str, ...] = ()

    def fits(self, message: dict) -> bool:
        """Whether a message of a thread that was found is one itself."""
        if any(message.get(name) is None for name in self.present):
            return False
        if self.newer is not None and (message["received_at"] is None or message["received_at"] <= self.newer):
            return False
        if self.unread is not None and bool(message.get("unread")) != self.unread:
            return False
        if not self.domains and not self.subject_domains:
            return True
        host = (re.search(r"@([a-z0-9.-]+)", (message.get("sender") or "").lower()) or ["", ""])[1]
        under = lambda names: any(host == d or host.endswith("." + d) for d in names)
        return under(self.domains) or under(self.subject_domains) and bool(re.search(self.subject, message.get("subject") or "", re.IGNORECASE))


class Mailbox(Protocol):
    """A mailbox's own interface."""

    def search(self, query: Query, page: int, size: int) -> list[dict]:
        """Threads (thread_id, permalink, messages) of a page, those with the newest message first; messages have the other columns."""


def client_of(options: dict[str, str]) -> Mailbox:
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


def _query(options: dict[str, str]) -> Query:
    names = lambda k: tuple(x.strip() for x in options.get(k, "").split(",") if x.strip())
    return Query(domains=names("domains"), subject_domains=names("subject_domains"), subject=options.get("subject", ""))


def _rows(threads: Sequence[dict]) -> Iterator[dict]:
    for t in threads:
        for m in t.get("messages") or []:
            yield {**m, "thread_id": t.get("thread_id"), "permalink": m.get("permalink") or t.get("permalink")}


def _tuple(row: dict) -> tuple:
    return tuple(row.get(f.name) for f in MAILBOX.fields)


class MailboxReader(DataSourceReader):
    """Reads pages one after the other; options: client, domains, subject_domains, subject, page (threads), pages, done (JSON list of ids)."""

    def __init__(self, options: dict[str, str]):
        self.options, self.query = dict(options), _query(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("received_at",) and isinstance(f.value, datetime):
                at = f.value if f.value.tzinfo else f.value.astimezone(UTC)
                if self.query.newer is None or at > self.query.newer:
                    self.query = replace(self.query, newer=at)
                if isinstance(f, GreaterThanOrEqual):
                    self.query = replace(self.query, newer=None)  # a search is for later times only
                    yield f
            elif isinstance(f, EqualTo) and f.attribute == ("unread",) and isinstance(f.value, bool):
                self.query = replace(self.query, unread=f.value)
            elif isinstance(f, IsNotNull) and f.attribute in (("received_at",), ("unread",)):
                self.query = replace(self.query, present=(*self.query.present, *f.attribute))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a page is needed to know whether the next one is

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client, size = client_of(self.options), int(self.options.get("page", Settings.max_threads_per_run))
        done = set(json.loads(self.options.get("done", "[]")))
        for page in range(int(self.options.get("pages", PAGES))):
            threads = client.search(self.query, page, size)
            found = [m for m in _rows(threads) if self.query.fits(m) and m.get("id") not in done]
            yield from map(_tuple, found)
            if found or len(threads) < size:
                return


class MailboxStream(SimpleDataSourceStreamReader):
    """New messages since the last offset (time in microseconds, id), oldest first; the same offsets give the same messages again."""

    def __init__(self, options: dict[str, str]):
        self.options, self.query = dict(options), _query(options)

    def initialOffset(self) -> dict:
        return {"at": int(self.options.get("from", 0)), "id": ""}

    def _since(self, start: dict) -> list[tuple[int, str, dict]]:
        client, size, page, out = client_of(self.options), int(self.options.get("page", Settings.max_threads_per_run)), 0, []
        newer = datetime.fromtimestamp(max(0, start["at"] - 1) / 1e6, UTC)
        while True:
            threads = client.search(replace(self.query, newer=newer), page, size)
            for m in _rows(threads):
                if m["received_at"] is not None and self.query.fits(m):
                    key = (round(m["received_at"].timestamp() * 1e6), m.get("id") or "")
                    if key > (start["at"], start["id"]):
                        out.append((*key, m))
            if len(threads) < size:
                return sorted(out, key=lambda x: x[:2])
            page += 1

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._since(start)
        end = {"at": found[-1][0], "id": found[-1][1]} if found else start
        return iter([_tuple(m) for *_, m in found]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([_tuple(m) for at, i, m in self._since(start) if (at, i) <= (end["at"], end["id"])])


class MailboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparkwarden_mailbox"

    def schema(self) -> Y.StructType:
        return MAILBOX

    def reader(self, schema: Y.StructType) -> MailboxReader:
        return MailboxReader(self.options)

    def simpleStreamReader(self, schema: Y.StructType) -> MailboxStream:
        return MailboxStream(self.options)


@dataclass
class Staged(WriterCommitMessage):
    """A task's file, and its rows."""

    name: str = ""
    rows: int = 0


@dataclass
class _Outbox:
    """What batch and stream writers share. Files go through Arrow's file systems, so `path` may be in any shared store."""

    path: str
    label: str = ""

    def _store(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pa.fs.LocalFileSystem(), self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        (fs, root), name, n, out = self._store(), f"staged/{uuid.uuid4().hex}.parquet", 0, None
        fs.create_dir(f"{root}/staged", recursive=True)
        try:
            for b in batches:
                out = out or pq.ParquetWriter(f"{root}/{name}", b.schema, filesystem=fs)
                out.write_batch(b)
                n += b.num_rows
        finally:
            if out:
                out.close()
        return Staged(name if out else "", n)

    def _commit(self, messages: Sequence[Staged | None], label: str) -> None:
        """Name the files of all tasks in one manifest, which appears whole; a batch that has one already keeps it."""
        fs, root = self._store()
        target = f"{root}/batch-{label}.json"
        if fs.get_file_info(target).type != pa.fs.FileType.NotFound:
            self._abort(messages)
            return
        draft = f"{root}/staged/{uuid.uuid4().hex}.json"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps([{"name": m.name, "rows": m.rows} for m in messages if m and m.name]).encode())
        fs.move(draft, target)

    def _abort(self, messages: Sequence[Staged | None]) -> None:
        fs, root = self._store()
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


class OutboxWriter(_Outbox, DataSourceArrowWriter):
    def commit(self, messages: list[Staged | None]) -> None:
        self._commit(messages, self.label or uuid.uuid4().hex)

    def abort(self, messages: list[Staged | None]) -> None:
        self._abort(messages)


class OutboxStreamWriter(_Outbox, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self._commit(messages, f"{self.label or 'stream'}-{batchId:012d}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self._abort(messages)


class OutboxSink(DataSource):
    """Options: path, and label, a name of the stream (or of the batch, which is then written once)."""

    @classmethod
    def name(cls) -> str:
        return "sparkwarden_outbox"

    def writer(self, schema: Y.StructType, overwrite: bool) -> OutboxWriter:
        return OutboxWriter(self.options["path"], self.options.get("label", ""))

    def streamWriter(self, schema: Y.StructType, overwrite: bool) -> OutboxStreamWriter:
        return OutboxStreamWriter(self.options["path"], self.options.get("label", ""))


def register(spark: SparkSession) -> None:
    """Make both known to the session, and let it push filters down to Python data sources."""
    spark.dataSource.register(MailboxSource)
    spark.dataSource.register(OutboxSink)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def committed(spark: SparkSession, path: str, schema: str) -> dict[str, DataFrame]:
    """The rows of each committed batch of an outbox sink, by label; what was only staged doesn't count."""
    from sparkwarden.streaming.store import children, read_text

    out = {}
    for name in children(spark, path):
        if name.startswith("batch-") and name.endswith(".json"):
            files = [f"{path}/{f['name']}" for f in json.loads(read_text(spark, f"{path}/{name}")) if f["rows"]]
            out[name[6:-5]] = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return out


def candidates(spark: SparkSession, client: str, cfg: Settings, done: Sequence[str] = (), options: dict[str, str] | None = None) -> DataFrame:
    """New messages of the wanted senders: the first page of threads that has any, at most PAGES pages. `done` is bounded by the outbox."""
    asked = {"client": client, "page": str(cfg.max_threads_per_run), "domains": ",".join(cfg.sender_domains), "subject_domains": ",".join(cfg.subject_sender_domains), "subject": cfg.sender_subject_pattern, "done": json.dumps(list(done))}
    found = spark.read.format("sparkwarden_mailbox").options(**asked, **(options or {})).load()
    return found.where(F.col("unread") & (F.col("received_at") > F.current_timestamp() - F.expr(f"interval {cfg.newer_than_days} days")))
