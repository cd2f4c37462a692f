"""The mailbox source (pushed conditions, pages that aren't read, offsets) and the outbox sink (tasks that fail, repeated batches)."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sparkwarden.plans.config import Settings
from sparkwarden.sources import mailbox
from sparkwarden.streaming.delivery import MAIL, Box

CLIENT = "tests.fake_mailbox:Fake"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    mailbox.register(spark)


def filled(root, threads, now):
    """threads: lists of (id, sender, subject, unread, age in seconds)."""
    rows = [{"thread_id": f"t{k}", "permalink": f"https://m/{k}", "messages": [dict(id=i, sender=s, subject=b, unread=u, received_at=now - age, plain_body="text") for i, s, b, u, age in t]} for k, t in enumerate(threads)]
    (root / "threads.json").write_text(json.dumps(rows))


def asked(root):
    return sorted(json.loads(f.read_text()) for f in (root / "asked").iterdir()) if (root / "asked").exists() else []


GOOD, SHOP = "J <j@mail.kleinanzeigen.de>", "x@ebay.de"


def test_conditions_reach_the_search_and_pages_are_not_read_without_need(spark, tmp_path):
    now = time.time()
    threads = [[(f"m{k}", GOOD, "s", True, 60 * k + 60), (f"r{k}", GOOD, "s", False, 60 * k + 90)] for k in range(7)]
    threads += [[("old", GOOD, "s", True, 9 * 86400)], [("ad", SHOP, "Dein Einkauf", True, 5)], [("ask", SHOP, "Neue Nachricht", True, 9000)], [("other", "a@kleinanzeigen.de.evil.org", "s", True, 5)]]
    filled(tmp_path, threads, now)
    cfg = Settings(max_threads_per_run=2)
    read = lambda done: mailbox.candidates(spark, CLIENT, cfg, done, {"root": str(tmp_path)})
    df = read([])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan sparkwarden_mailbox" in plan  # Spark has nothing left to filter
    assert sorted(r.id for r in df.collect()) == ["m0", "m1"]
    pages = asked(tmp_path)
    assert [p[:2] for p in pages] == [[0, 2]] and pages[0][3] is True and pages[0][2] != "None" and "willhaben.at" in pages[0][4]
    assert sorted(r.id for r in read(["m0", "m1", "m2"]).collect()) == ["m3"]
    assert [p[0] for p in asked(tmp_path)] == [0, 0, 1]
    assert read([f"m{k}" for k in range(6)]).count() == 0 and len(asked(tmp_path)) == 6  # three pages, no more
    wide = mailbox.candidates(spark, CLIENT, Settings(max_threads_per_run=50), [], {"root": str(tmp_path)})
    assert {r.id for r in wide.collect()} == {*(f"m{k}" for k in range(7)), "ask"}
    assert wide.where("subject = 's' and thread_id = 't1'").count() == 1


def test_a_stream_of_messages_has_offsets(spark, tmp_path):
    now = time.time()
    filled(tmp_path, [[("a", GOOD, "s", True, 100), ("b", GOOD, "s", False, 100)], [("c", GOOD, "s", True, 50)]], now)

    def run():
        stream = spark.readStream.format("sparkwarden_mailbox").option("client", CLIENT).option("root", str(tmp_path)).option("page", "1").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.id for r in spark.read.schema(mailbox.MAILBOX).parquet(str(tmp_path / "out")).collect())

    assert run() == ["a", "b", "c"]
    filled(tmp_path, [[("a", GOOD, "s", True, 100), ("b", GOOD, "s", False, 100), ("d", GOOD, "s", True, 10)], [("c", GOOD, "s", True, 50)]], now)
    assert run() == ["a", "b", "c", "d"]


def test_a_task_that_fails_leaves_nothing_to_deliver(spark, tmp_path):
    path, columns = str(tmp_path / "sink"), [c.split()[0] for c in MAIL.split(",")]
    rows = spark.range(40).select(F.col("id").cast("string").alias("id"), *[F.lit("x").alias(c) for c in columns[1:] if c != "received_at"], F.current_timestamp().alias("received_at")).select(*columns).repartition(4)
    rows.write.format("sparkwarden_outbox").option("path", path).option("label", "first").mode("append").save()
    broken = rows.withColumn("subject", F.when(F.col("id") == "39", F.raise_error("no")).otherwise("x"))
    with pytest.raises(Exception, match="no"):
        broken.write.format("sparkwarden_outbox").option("path", path).mode("append").save()
    rows.write.format("sparkwarden_outbox").option("path", path).option("label", "first").mode("append").save()  # the same again
    got = mailbox.committed(spark, path, MAIL)
    assert list(got) == ["first"] and got["first"].count() == 40
    box = Box(spark, str(tmp_path / "box"))
    assert [box.take(path), box.take(path)] == [1, 0] and box.state(5).count() == 40


def test_a_stream_into_the_outbox(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "sink")
    rows = spark.range(3).selectExpr("string(id) id", "'t' thread_id", "'s' subject", "'f' sender", "'' reply_to", "current_timestamp() received_at", "'p' plain_body", "'' html_body", "'' permalink")
    box = Box(spark, str(tmp_path / "box"))
    for k in range(2):
        rows.withColumn("id", F.concat("id", F.lit(f"-{k}"))).coalesce(1).write.mode("append").parquet(source)
        q = spark.readStream.schema(rows.schema).parquet(source).writeStream.format("sparkwarden_outbox").option("path", path).option("label", "s").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert box.take(path) == 1
    assert sorted(r.id for r in box.known().collect()) == [f"{i}-{k}" for i in range(3) for k in range(2)]
