"""The throttle of tables and streams against a plain loop: hot keys over many stretches, ties, nulls, restarts of a stream."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwarden.streaming import throttle

SCHEMA = "who string, at double, n int, _key string"


def plain(rows, span):
    """(who, n) that pass."""
    out, until = [], {}
    for who, at, n, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        if at >= until.get((who,), float("-inf")):
            until[(who,)] = at + span
            out.append((who, n))
    return sorted(map(str, out))


def made(seed, n=3000, far=400_000):
    draw = random.Random(seed)
    who = lambda: draw.choice(["hot"] * 8 + ["a", "b", "c", None, ""])
    return [(who(), draw.choice([None, *[round(draw.uniform(-far, far), draw.choice([0, 0, 6])) for _ in range(20)]]), k, "clash") for k in range(n)]


@pytest.mark.parametrize("seconds", [60, 977, 10**9])
def test_equals_a_plain_loop(spark, seconds):
    rows = made(seconds) + [("even", 60.0 * k, k, "") for k in range(200)] + [("late", 960.0 * 60 - 1e-6, 1, ""), ("late", 960.0 * 60, 2, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("t", F.expr("timestamp_micros(cast(round(at * 1000000) as bigint))")).repartition(5)
    got = throttle.throttled(df, "who", "t", seconds, "n")
    assert sorted(str((r.who, r.n)) for r in got.collect()) == plain(rows, min(max(seconds, 60), 6 * 3600)) and got.columns == df.columns
    assert throttle.throttled(df.limit(0), "who", "t", seconds).count() == 0


def test_a_stream_equals_the_table_over_restarts(spark, tmp_path):
    rows = sorted(((r[0], r[1] + 1_000_000, *r[2:]) for r in made(7, 900) if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2]))[:800]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("t", F.expr("timestamp_micros(cast(round(at * 1000000) as bigint))"))
    for k in range(4):  # in order of time, a quarter a micro-batch
        df.where(F.col("n").isin([r[2] for r in rows[200 * k : 200 * k + 200]])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        passed = throttle.throttled_stream(stream, "who", "t", 3600, "n")
        with throttle.rocksdb_state(spark):
            q = passed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()  # each quarter by a query of its own, as after a restart
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(str((r.who, r.n)) for r in got) == plain(rows, 3600)
    assert "HDFS" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
