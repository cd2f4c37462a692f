"""A throttle of rows by key: the first row of a key passes, then the next one `seconds` or more after the last that passed.

On a table, a key's history is cut into stretches of time, so no task sees all of it. What a stretch does is a rising step function: it
takes the time until which the key is closed and gives the time at its end. These steps, a few numbers a stretch, are put one after the
other for each key; then every stretch knows its start and passes its rows. On a stream, the time is state with an event-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds of the shortest and longest throttle; spans in a stretch.
SHORTEST, LONGEST, STRETCH = 60, 6 * 3600, 16
NEVER = -(2**63)


def span_of(seconds: float) -> int:
    """Microseconds of a throttle, within its bounds."""
    return int(min(max(seconds, SHORTEST), LONGEST) * 1_000_000)


def steps(times: np.ndarray, begin: int, span: int) -> tuple[list[int], list[int]]:
    """What sorted times from `begin` on do: (up to, exits), a key closed until u <= up_to[k] (first such k) is closed until exits[k] at the end.

    Only u below begin + span can occur, or no u at all; u beyond the last step stays as it is.
    """
    times = np.unique(times)
    following = np.searchsorted(times, times + span, "left")
    exits = times + span
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            exits[i] = exits[following[i]]
    n = min(int(np.searchsorted(times, begin + span, "left")) + 1, len(times))  # one beyond, for u just below the bound
    last = np.append(exits[1:n] != exits[: n - 1], True)
    return times[:n][last].tolist(), exits[:n][last].tolist()


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Pieces of sorted batches that belong to one group (their first n_keys columns), and whether a group begins with the piece."""
    last: tuple | None = None
    for batch in batches:
        codes = np.array([np.asarray(batch.column(k).dictionary_encode("encode").indices) for k in range(n_keys)])
        ends = np.append(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1, batch.num_rows) if batch.num_rows else []
        i = 0
        for j in map(int, ends):
            key = tuple(batch.column(k)[i].as_py() for k in range(n_keys))
            yield key, batch.slice(i, j - i), key != last
            last, i = key, j


def _summaries(span: int, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now: tuple | None = None

        def done() -> pa.RecordBatch:
            upto, exits = steps(np.concatenate(held), now[1] * stretch, span)
            return pa.record_batch([pa.array([now[0]], key_type), pa.array([now[1]], pa.int64()), pa.array([upto], pa.list_(pa.int64())), pa.array([exits], pa.list_(pa.int64()))], names=["_key", "_stretch", "_upto", "_exits"])

        key_type = None
        for key, piece, first in _groups(batches, 2):
            key_type = piece.schema.field(0).type
            if first and held:
                yield done()
                held = []
            now = key
            held.append(np.unique(np.asarray(piece.column(2))))
        if held:
            yield done()

    return run


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Until when a key is closed at the start of each stretch, from its stretches in order."""
    until = NEVER
    for _, piece, first in _groups(batches, 1):
        until = NEVER if first else until
        out = []
        for upto, exits in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist()):
            out.append(until)
            k = int(np.searchsorted(upto, until, "left"))
            until = exits[k] if k < len(exits) else until
        yield pa.record_batch([piece.column(0), piece.column(1), pa.array(out, pa.int64())], names=["_key", "_stretch", "_until"])


def _passing(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        until = NEVER
        for _, piece, first in _groups(batches, 2):
            i = 0
            if first:  # the row that says until when the key is closed
                until, i = piece.column(2)[0].as_py(), 1
            times, keep = np.asarray(piece.column(3).fill_null(0)), []
            while (i := i + int(np.searchsorted(times[i:], until, "left"))) < len(times):
                keep.append(i)
                until = int(times[i]) + span
            yield piece.take(pa.array(keep, pa.int64()))

    return run


def throttled(df: DataFrame, key: str, time: str, seconds: int, tie: str | None = None) -> DataFrame:
    """Rows that pass a throttle: of each key the first, then the next one `seconds` (60 s to 6 h) or more after the last that passed.

    Rows of a key are taken in order of time, then `tie`; rows with a null time never pass, a null key is a key. A task holds the
    different times of one key in one stretch of 16 throttles, as numbers, and else streams.
    """
    span = span_of(seconds)
    stretch = span * STRETCH
    number = F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    names = [f"_c{k}" for k in range(len(df.columns))]
    flat = df.select(F.col(f"`{key}`").alias("_key"), number.alias("_number"), (F.col(f"`{tie}`") if tie else F.lit(0)).alias("_tie"), *[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])
    flat = flat.where("_number is not null").withColumn("_stretch", F.expr(f"(_number - pmod(_number, {stretch}L)) div {stretch}L"))
    kind = flat.schema["_key"].dataType.simpleString()
    short = flat.select("_key", "_stretch", "_number").repartition("_key", "_stretch").sortWithinPartitions("_key", "_stretch")
    summary = short.mapInArrow(_summaries(span, stretch), f"_key {kind}, _stretch long, _upto array<long>, _exits array<long>")
    starts = summary.repartition("_key").sortWithinPartitions("_key", "_stretch").mapInArrow(_starts, f"_key {kind}, _stretch long, _until long")
    both = flat.withColumn("_until", F.lit(None).cast("long")).unionByName(starts, allowMissingColumns=True)
    dealt = both.select("_key", "_stretch", "_until", "_number", "_tie", *names).repartition("_key", "_stretch").sortWithinPartitions("_key", "_stretch", F.asc_nulls_first("_number"), "_tie")
    return dealt.mapInArrow(_passing(span), dealt.schema).select(*[F.col(n).alias(c) for c, n in zip(df.columns, names)])


class Throttle(StatefulProcessor):
    """Of each key the time until which it is closed; a timer lets go of it once the watermark is there, so state doesn't pile up."""

    def __init__(self, key: str, time: str, tie: str | None, span: int):
        self.key, self.time, self.tie, self.span = key, time, tie, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", Y.StructType([Y.StructField("until", Y.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else NEVER
        before = until
        # a micro-batch's rows of a key
        every = pd.concat(list(rows))
        every = every[every[self.time].notna()].sort_values([self.time] + ([self.tie] if self.tie else []), kind="stable")
        times, keep, i = every[self.time].astype("datetime64[us]").astype("int64").to_numpy(), [], 0
        while (i := i + int(np.searchsorted(times[i:], until, "left"))) < len(times):
            keep.append(i)
            until = int(times[i]) + self.span
        if until != before:
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            self.until.update((until,))
            self.handle.registerTimer(-(-until // 1000))
        yield every.iloc[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def throttled_stream(stream: DataFrame, key: str, time: str, seconds: int, tie: str | None = None, late: str = "1 hour") -> DataFrame:
    """`throttled` for a stream: state by key outlives restarts and replays (checkpoint), and ends `late` after the key opens again.

    Rows have to come in order of time across micro-batches but for `late` (later ones, and any before 1970, are dropped); within a micro-batch any order will do. The session needs the
    RocksDB state store (`rocksdb_state`).
    """
    names = {c: f"c{k}" for k, c in enumerate(stream.columns)}  # none that Spark or pandas uses itself
    flat = stream.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withWatermark(names[time], late)
    by_key = Throttle(names[key], names[time], names[tie] if tie else None, span_of(seconds))
    out = flat.groupBy(names[key]).transformWithStateInPandas(by_key, flat.schema, "Append", "EventTime")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here keep their state in RocksDB, which state with timers needs; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
