"""Mails are delivered once and none is lost: limits, failures, restarts, faults of the store, and the entry points around it."""

import json

import pytest
from pyspark.sql import functions as F

from sparkwarden import app
from sparkwarden.plans.config import Settings
from sparkwarden.sources import messages
from sparkwarden.streaming import channel, delivery, model_client, store
from sparkwarden.streaming.delivery import Box, Response, Timers

BOX = "id string, received_at timestamp, skip_reason string"
SAME = lambda df: df


def delivered(box, *args, **more):
    """One run under a lease of its own."""
    lease = box.log.acquire(100)
    try:
        return delivery.deliver(box, lease, *args, **more)
    finally:
        box.log.release(lease)


def offered(spark, n, skip=()):
    rows = [(str(k), f"2024-01-01 00:{k:02d}:00", "skip" if k in skip else None) for k in range(n)]
    return spark.createDataFrame(rows, "id string, t string, skip_reason string").select("id", F.col("t").cast("timestamp").alias("received_at"), "skip_reason")


def test_no_mail_is_lost_beyond_a_runs_limit(spark, tmp_path):
    box, sent, cfg, timers = Box(spark, str(tmp_path / "box"), BOX), [], Settings(), Timers()
    box.offer(offered(spark, 20, skip=(3,)))
    run = lambda: delivered(box, SAME, SAME, lambda r: sent.append(r["id"]), cfg, timers)
    stats = [run() for _ in range(4)]
    assert [(s["candidates"], s["sent"], s["deferred"]) for s in stats] == [(20, 8, 11), (11, 8, 3), (3, 3, 0), (0, 0, 0)]
    assert sent == [str(k) for k in range(20) if k != 3]


def test_failed_mails_come_again_until_given_up(spark, tmp_path):
    box, sent, alerts, marked = Box(spark, str(tmp_path / "box"), BOX), [], [], []
    cfg, timers = Settings(max_messages_per_run=3, max_delivery_attempts=2), Timers()
    box.offer(offered(spark, 6, skip=(3,)))
    broken = {"1", "2"}

    def send(row):
        if row["id"] in broken:
            raise ValueError("no")
        sent.append(row["id"])

    def after(row):
        marked.append(row["id"])
        raise RuntimeError("a failure behind the send sends nothing twice")

    run = lambda: delivered(box, SAME, SAME, send, cfg, timers, lambda *a: alerts.append(a), after)
    assert run() == dict(candidates=6, sent=1, skipped=1, failed=2, deferred=2)
    broken.discard("2")
    assert run() == dict(candidates=4, sent=2, skipped=0, failed=1, deferred=1)
    assert run() == dict(candidates=1, sent=1, skipped=0, failed=0, deferred=0) and run()["candidates"] == 0
    assert sent == ["0", "2", "4", "5"] == marked and [a[0] for a in alerts] == ["giveup-1"]


def test_no_time_left_defers(spark, tmp_path):
    box = Box(spark, str(tmp_path / "box"), BOX)
    box.offer(offered(spark, 2))
    stats = delivered(box, SAME, SAME, lambda r: None, Settings(), Timers(clock=lambda: 0.0), deadline=10.0)
    assert stats == dict(candidates=2, sent=0, skipped=0, failed=0, deferred=2)


def statuses(box, limit=5):
    return {r["id"]: (r["status"], r["attempts"], r["done"]) for r in box.state(limit).collect()}


class Crash(BaseException):
    """The process ends here."""


@pytest.mark.parametrize("point", range(6))
@pytest.mark.parametrize("written", [False, True])
def test_nothing_is_sent_twice_or_lost_wherever_a_run_dies(spark, tmp_path, monkeypatch, point, written):
    box, sent, told, count = Box(spark, str(tmp_path / "box"), BOX), [], [], [0]
    box.offer(offered(spark, 3, skip=(1,)))
    real = store.publish

    def dying(spark, path, text):
        if count[0] >= 0:
            count[0] += 1
            if count[0] == point + 1:
                if written:
                    real(spark, path, text)
                raise Crash
        return real(spark, path, text)

    lease = box.log.acquire(100)
    monkeypatch.setattr(store, "publish", dying)  # skipped, intent, outcome, intent, outcome
    run = lambda lease: delivery.deliver(box, lease, SAME, SAME, lambda r: sent.append(r["id"]), Settings(), Timers(), lambda key, *a: told.append(key))
    try:
        run(lease)
    except Crash:
        pass
    count[0] = -1
    later = Box(spark, box.path, BOX, clock=lambda: 4e9)  # the lease has ended by then
    run(later.log.acquire(100))
    doubtful = [k.removeprefix("uncertain-") for k in told]
    assert len(sent) == len(set(sent)) and len(doubtful) <= 1 and set(sent) | set(doubtful) == {"0", "2"}
    assert all(done for _, _, done in statuses(later).values()) and statuses(later)["1"][0] == "skipped"


def test_mails_and_their_outcomes_go_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delivery, "KEEP_DONE", 10)
    monkeypatch.setattr(delivery, "KEEP_ATTEMPTS", 0)
    now = [1_704_000_000.0 + 5 * 86400]  # January 2024, as the mails
    box, sent, cfg = Box(spark, str(tmp_path / "box"), BOX, clock=lambda: now[0]), [], Settings(max_messages_per_run=60)
    box.offer(offered(spark, 50))
    run = lambda: delivered(box, SAME, SAME, lambda r: sent.append(r["id"]), cfg, Timers())
    monkeypatch.setattr(delivery, "RECORDS", 20)
    assert run()["sent"] == 50 and len(box.log.head().parts) == 1 and not box.log.head().records
    now[0] += 30 * 86400
    box.offer(offered(spark, 2).withColumn("id", F.concat(F.lit("new-"), "id")))
    monkeypatch.setattr(delivery, "PARTS", 1)
    assert run()["sent"] == 2 and box.state(5).count() == 10  # the newest ten stay
    assert run()["candidates"] == 0 and len(sent) == len(set(sent)) == 52
    monkeypatch.setattr(delivery, "RECORDS", 0)
    box.offer(offered(spark, 1).withColumn("id", F.lit("late")))
    assert run()["sent"] == 1 and run()["candidates"] == 0 and box.state(5).count() == 10


def test_attempts_and_doubts_outlive_a_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delivery, "RECORDS", 0)
    box, told = Box(spark, str(tmp_path / "box"), BOX), []
    box.offer(offered(spark, 2))
    run = lambda send: delivered(box, SAME, SAME, send, Settings(max_delivery_attempts=3), Timers(), lambda key, *a: told.append(key))
    assert run(lambda r: 1 / 0)["failed"] == 2 and run(lambda r: 1 / 0)["failed"] == 2 and statuses(box)["0"] == ("open", 2, False)
    lease = box.log.acquire(100)
    box.note(lease, ("0", "intent", 0))
    box.tidy(lease, Settings())
    box.log.release(lease)
    assert len(box.log.head().parts) == 1 and run(lambda r: 1 / 0)["failed"] == 1 and told == ["uncertain-0", "giveup-1"]
    assert statuses(box, 3)["1"][1:] == (3, True) and run(lambda r: None)["candidates"] == 0 and statuses(box, 99)["1"][2]


def test_mails_without_an_id_are_delivered_once(spark, tmp_path):
    box, sent = Box(spark, str(tmp_path / "box"), BOX), []
    rows = offered(spark, 3).withColumn("id", F.when(F.col("id") != "0", F.lit(None)).otherwise(F.col("id")))
    for _ in range(2):
        box.offer(rows)
        delivered(box, SAME, SAME, lambda r: sent.append(r["id"]), Settings(), Timers())
    assert len(sent) == 3 and sent[0] == "0" and all(i.startswith("content-") for i in sent[1:])


def test_leases(spark, tmp_path):
    now = [100.0]
    records = store.RecordLog(spark, str(tmp_path / "log"), "id string, status string, attempts int, at timestamp", lambda: now[0])
    first = records.acquire(10)
    assert first and records.acquire(10) is None
    now[0] = 200.0
    second = records.acquire(10)
    with pytest.raises(store.Fenced):
        records.commit(lambda head: head.note("a", "sent", 0, 1.0), first)
    records.release(first)  # a late owner doesn't end its successor's lease
    assert records.acquire(10) is None and records.head().owner == second.owner and records.head().records == []
    records.release(second)
    assert records.acquire(10).token == 3


def test_of_two_who_find_a_lease_ended_one_gets_it(spark, tmp_path, monkeypatch):
    make = lambda: store.RecordLog(spark, str(tmp_path / "log"), "id string, status string, attempts int, at timestamp")
    one, two, real, got = make(), make(), store.publish, []

    def between(spark, path, text):
        monkeypatch.setattr(store, "publish", real)
        got.append(two.acquire(100))  # the other one comes between reading and writing
        return real(spark, path, text)

    monkeypatch.setattr(store, "publish", between)
    assert one.acquire(100) is None and got[0].token == 1
    two.commit(lambda head: head.note("a", "sent", 0, 1.0), got[0])
    assert [r["id"] for r in one.head().records] == ["a"]


def test_broken_state_is_put_aside_and_made_again(spark, tmp_path, monkeypatch):
    box, sent, told = Box(spark, str(tmp_path / "box"), BOX), [], []
    box.offer(offered(spark, 3))
    run = lambda: delivered(box, SAME, SAME, lambda r: sent.append(r["id"]), Settings(), Timers(), lambda key, *a: told.append(key))
    monkeypatch.setattr(delivery, "RECORDS", 0)
    assert run()["sent"] == 3

    def broken(name):
        for f in (tmp_path / "box" / name).rglob("*.parquet"):
            f.write_bytes(b"broken")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)

    broken(box.log.head().parts[0]["name"])  # the merged part is made again from what it was merged from
    assert run()["candidates"] == 0 and sent == ["0", "1", "2"] and not told
    box.offer(offered(spark, 4))
    broken(box.log.head().parts[-1]["name"])  # an offered part isn't there any more: it is told, and can be offered again
    assert run()["candidates"] == 0 and told == ["state"]
    box.offer(offered(spark, 4))
    assert run()["sent"] == 1 and sent == ["0", "1", "2", "3"]
    newest = max((tmp_path / "box").glob("v-*.json"), key=lambda f: int(f.stem[2:]))
    newest.write_text("{")
    assert run()["candidates"] == 0 and len(list((tmp_path / "box").glob("bad-*"))) >= 3  # the version's copy holds


def test_a_part_that_cannot_be_read_never_counts_as_empty(spark, tmp_path):
    records = store.RecordLog(spark, str(tmp_path / "log"), "id string, status string, attempts int, at timestamp")
    part = records.write_part(spark.createDataFrame([("a", "sent", 0)], "id string, status string, attempts int"))
    records.commit(lambda head: head.parts.append(part))
    for f in (tmp_path / "log").rglob("*.parquet"):
        f.unlink()
    (tmp_path / "log" / part["name"] / "part-0.parquet").write_bytes(b"broken")
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        records.rows().collect()


def test_a_stream_fills_the_box_and_repeats_count_once(spark, tmp_path):
    source, sent, box = str(tmp_path / "in"), [], Box(spark, str(tmp_path / "box"))
    rows = spark.createDataFrame([(str(k), "t", "s", "f", "", f"2024-01-01 00:{k:02d}:00", "p", "", "") for k in range(20)], "id string, thread_id string, subject string, sender string, reply_to string, received_at string, plain_body string, html_body string, permalink string")
    rows = rows.withColumn("received_at", F.col("received_at").cast("timestamp"))
    rows.coalesce(1).write.parquet(source)
    rows.coalesce(1).write.mode("append").parquet(source)
    screen = lambda df: df.withColumn("skip_reason", F.lit(None).cast("string"))
    run = lambda: delivered(box, screen, SAME, lambda r: sent.append(r["id"]), Settings(), Timers())
    assert box.offer(rows.limit(1), "s", 4) and not box.offer(rows.limit(1), "s", 4) and not box.offer(rows.limit(1), "s", 3)
    for _ in range(2):  # a restart finds nothing new
        q = delivery.collect(spark.readStream.schema(messages.MAIL).option("maxFilesPerTrigger", 1).parquet(source), box, str(tmp_path / "check"), Settings(), run, available_now=True)
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
    delivery.serve(run, Settings(), 2, lambda s: None)
    assert sent == [str(k) for k in range(20)]


def test_with_slow_models_each_run_sends_at_least_one(spark, tmp_path, monkeypatch):
    now, box, sent = [1000.0], Box(spark, str(tmp_path / "box"), BOX), []
    box.offer(offered(spark, 3))

    chain, _ = _chain(*[GOOD] * 3)
    slow = chain.transport

    def transport(*args):
        now[0] += 200  # a model that takes most of a run
        return slow(*args)

    inbox = app.Inbox(spark, box, channel.Channel(Bot(), "u", "7"), chain.cfg, lambda: None, chain, Timers(clock=lambda: now[0]))
    chain.transport, ask = transport, inbox._asked
    monkeypatch.setattr(app.pipeline, "prompts", lambda mails, *a: mails.select("id", F.col("id").alias("prompt")))
    for k in range(3):
        deadline, answers = now[0] + 270, {}
        stats = delivered(box, SAME, SAME, lambda r: sent.append(r["id"]), Settings(), inbox.timers, deadline=deadline, admit=lambda ids, m: ask(ids, m, deadline, answers))  # noqa: B023
        assert (stats["candidates"], stats["sent"], stats["deferred"]) == (3 - k, 1, 2 - k)
    assert sent == ["0", "1", "2"]


def test_a_run_that_lost_its_lease_writes_nothing(spark, tmp_path):
    box, sent = Box(spark, str(tmp_path / "box"), BOX), []
    box.offer(offered(spark, 3))
    old = box.log.acquire(0)

    def send(row):
        sent.append(row["id"])
        assert box.log.acquire(100)  # meanwhile the next run begins

    with pytest.raises(store.Fenced):
        delivery.deliver(box, old, SAME, SAME, send, Settings(), Timers())
    assert sent == ["0"] and statuses(box)["0"][0] in ("intent", "offered") and {r["id"] for r in box.open(5).where("doubt").collect()} == {"0"}


def test_timers_outlive_the_process(spark, tmp_path):
    box, now = Box(spark, str(tmp_path / "box"), clock=lambda: now[0]), [1000.0]
    make = lambda: app.Inbox(spark, box, channel.Channel(Bot(), "u", "7"), Settings(), lambda: None, _chain()[0], Timers(clock=lambda: now[0]))
    first = make()
    first.chain.pause(600, "used up")
    assert first.alerts.error("a", "t") and not first.alerts.error("a", "t")
    second = make()
    assert second.chain.paused() == "used up" and not second.alerts.error("a", "t")
    now[0] += 601
    assert make().chain.paused() is None and not make().alerts.error("a", "t")
    now[0] += 3600
    assert make().alerts.error("a", "t") and set(box.log.head().timers) == {"alert.a"}


def test_secrets_never_reach_a_handler(caplog):
    channel.set_up_log(Settings(log_level="warning", secrets={"bot_token": "12345678secret", "chat_id": "7"}))
    log = channel.log
    with caplog.at_level("WARNING", "sparkwarden"):
        log.info("quiet")
        log.warning("failed at https://b/bot12345:%s with %s", "abcdefghijklmnopqrstuv", "12345678secret")
        try:
            raise OSError("no route to bot12345:abcdefghijklmnopqrstuv")
        except OSError:
            log.exception("stopped")
    assert len(caplog.records) == 2 and "no route" in caplog.text and "12345678secret" not in caplog.text and "abcdefghij" not in caplog.text
    channel.set_up_log(Settings())


def test_request_waits():
    waits, answers = [], [Response(503), OSError("net"), Response(429, "", {"Retry-After": "2"}), Response(200, "ok")]

    def transport(*_):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert delivery.request(transport, "get", "u", retries=3, sleep=waits.append, jitter=lambda: 0).text == "ok" and waits == [1.0, 2.0, 2.0]
    assert delivery.request(lambda *_: Response(503), "get", "u", sleep=lambda s: None).status == 503
    assert delivery.request(lambda *_: Response(404, "gone"), "get", "u").text == "gone"
    assert delivery.request(lambda *_: Response(503), "get", "u", deadline=11.0, clock=lambda: 0.0, sleep=waits.append, jitter=lambda: 1).status == 503 and len(waits) == 3
    assert delivery.asked_wait(Response(429, "", {"retry-after": "Thu, 01 Jan 1970 00:01:00 GMT"}), 50.0) == 10.0 and delivery.asked_wait(Response(429, "", {"retry-after": "99"}), 0) == 30.0


class Bot:
    """A channel's server: answers by method and keeps what it was sent."""

    def __init__(self, *answers):
        self.answers, self.got = list(answers), []

    def __call__(self, method, url, headers, body):
        self.got.append((url.rsplit("/", 1)[-1], body))
        status, text = self.answers.pop(0) if self.answers else (200, {"ok": True, "result": {"username": "bot"}})
        return Response(status, json.dumps(text))


def test_channel():
    waits = []
    bot = Bot((400, {"description": "can't parse entities"}))
    channel.Channel(bot, "https://b/bot1:x", "7", waits.append).send("<b>a &amp; b</b>", {"k": 1})
    assert [b.get("parse_mode") for _, b in bot.got] == ["HTML", None] and bot.got[1][1]["text"] == "a & b" and "reply_markup" not in bot.got[1][1]
    bot = Bot((429, {"parameters": {"retry_after": 3}}))
    channel.Channel(bot, "u", "7", waits.append).send("x")
    assert waits == [3] and len(bot.got) == 2
    for answer in ((403, {"description": "bot was blocked by the user"}), (400, {"description": "Bad Request: chat not found"}), (401, {})):
        with pytest.raises(delivery.FatalError):
            channel.Channel(Bot(answer), "u", "7").send("x")
    with pytest.raises(channel.ChannelError):
        channel.Channel(Bot((429, {"parameters": {"retry_after": 99}})), "u", "7").send("x")
    bot = Bot()
    alerts = channel.Alerts(channel.Channel(bot, "u", "7"), Settings(secrets={"k": "verysecret"}), Timers())
    assert alerts.error("a", "t <x>", ValueError("verysecret bot12345:abcdefghijklmnopqrstuv")) and not alerts.error("a", "t", None)
    assert "verysecret" not in bot.got[0][1]["text"] and "abcdefghij" not in bot.got[0][1]["text"] and "&lt;x&gt;" in bot.got[0][1]["text"]


GOOD = json.dumps({"intent": "KAUFINTERESSE", "scamRisk": "LOW", "replyDraft": "Hallo [NAME],\nja, gerne. Viele Grüße"})


def _chain(*answers, **more):
    got = []

    def transport(method, url, headers, body):
        got.append((url, body))
        x = answers[len(got) - 1]
        return x if isinstance(x, Response) else Response(200, json.dumps({"choices": [{"message": {"content": x}}], "model": "m"}))

    cfg = Settings(llm_models=("a/one:free", "b/two"), **more)
    return model_client.ModelChain(transport, "https://m", "key", cfg, Timers(clock=lambda: 1000.0), sleep=lambda s: None), got


def test_model_chain():
    chain, got = _chain("no json", GOOD)
    assert chain.ask("s", "u")[1] == GOOD and [b["model"] for _, b in got] == ["a/one:free", "b/two"]
    chain, got = _chain(Response(400, "{}"), GOOD)
    assert chain.ask("s", "u") and "response_format" not in got[1][1] and got[1][1]["messages"] == [{"role": "user", "content": "s\n\nu"}]
    chain, got = _chain(Response(404, "{}"), Response(500, ""), Response(500, ""))
    with pytest.raises(model_client.ModelError, match="one: .*404.*two: HTTP 500"):
        chain.ask("s", "u")
    for status, text, seconds in ((402, "{}", 3600), (429, json.dumps({"error": {"message": "limit: 50 per day"}}), 500)):
        chain, got = _chain(Response(status, text, {"X-RateLimit-Reset": "1500000" if seconds == 3600 else "1500"}) if status == 429 else Response(status, text))
        with pytest.raises(model_client.ModelError) as e:
            chain.ask("s", "u")
        assert e.value.fatal and len(got) == 1 and chain.paused() and chain.timers.until[model_client.PAUSE_KEY] == 1000 + seconds
        chain.clear()
        assert chain.paused() is None
    chain, got = _chain(Response(429, "{}"), GOOD)
    assert chain.ask("s", "u") and chain.paused() is None  # a short limit goes on to the next model
    chain, got = _chain()
    with pytest.raises(model_client.ModelError, match="no time left"):
        chain.ask("s", "u", deadline=1010.0)
    alerts = []
    chain, got = _chain(GOOD, Response(401, "{}"))
    chain.alert = lambda *a: alerts.append(a[0])
    assert chain.answers("s", ["p", "q", "r"]) == {"p": ("m", GOOD), "q": (None, None)} and alerts == ["llm-401"]
    chain, got = _chain(GOOD, llm_zdr_only=True, llm_reasoning_effort="low")
    chain.ask("s", "u")
    assert got[0][1]["provider"] == {"zdr": True, "data_collection": "deny"} and got[0][1]["reasoning"]["effort"] == "low"


@pytest.fixture
def inbox(spark, tmp_path):
    mails = app.samples(spark).withColumn("received_at", F.current_timestamp())
    chain, got = _chain(*[GOOD] * 9)
    cfg = Settings(llm_models=("a/one:free",), create_drafts=True, secrets={"bot_token": "t", "chat_id": "7", "model_key": "k"})
    chain.cfg = cfg
    box = app.Inbox(spark, Box(spark, str(tmp_path / "box")), channel.Channel(Bot(), "https://b/bot1:x", "7"), cfg, lambda: mails, chain)
    box.asked, box.drafts, box.marked = got, [], []
    box.draft, box.mark = lambda row, text: box.drafts.append((row["id"], text)), lambda row: box.marked.append(row["id"])
    return box


def test_runs_of_an_inbox(inbox):
    first = inbox.run()
    assert (first["candidates"], first["sent"]) == (3, 3) and inbox.run()["candidates"] == 0
    assert inbox.marked == ["sample-0", "sample-1", "sample-2"] and [i for i, _ in inbox.drafts] == ["sample-0"] and len(inbox.asked) == 1
    texts = [b["text"] for _, b in inbox.channel.transport.got]
    assert "Risiko gering" in texts[0] and "Risiko hoch" in texts[1] and "Risiko hoch" in texts[2]
    inbox.reset()
    rows = [(f"sample-{k}", "text", None, False, False, "LOW", "reply", "LLM") for k in range(3)]
    done = inbox.spark.createDataFrame(rows, "id string, notification string, buttons string, silent boolean, plain_only boolean, level string, reply string, reply_source string")
    inbox._prepared = lambda mails, *a, **k: done  # what follows is not about the analysis
    assert inbox.run()["sent"] == 3
    lease = inbox.box.log.acquire(100)
    assert inbox.run() is None
    inbox.box.log.release(lease)
    inbox.mails = lambda: 1 / 0
    assert inbox.run() is None and "the run was stopped" in inbox.channel.transport.got[-1][1]["text"]
    inbox.reset()
    inbox.channel.transport.answers = [(403, {"description": "bot was blocked"})]
    with pytest.raises(delivery.FatalError):
        inbox.run(offer=False)


def test_entry_points(inbox):
    assert [(n, level) for n, level, *_ in inbox.send_samples()] == [("preis", "LOW"), ("kurier", "HIGH"), ("zahlseite", "HIGH")]
    assert all("Probe" in b["text"] for _, b in inbox.channel.transport.got) and inbox.box.log.head().version == 0
    done = inbox.spark.createDataFrame([("x", "text", None, False, False, "LOW", "LLM")], "id string, notification string, buttons string, silent boolean, plain_only boolean, level string, reply_source string")
    inbox._prepared = lambda mails, *a, **k: done
    assert inbox.test_latest() == ("LOW", "LLM")
    shown = inbox.explain_latest()
    assert shown["extraction"] == "MARKER" and shown["text"] and "Sicherheitshinweis" in shown["raw_body"]
    models = {"data": [{"id": "a/one:free", "context_length": 1, "architecture": {"output_modalities": ["text"]}}, {"id": "paid", "pricing": {"prompt": "1", "completion": "1"}}]}
    inbox.chain.transport = lambda m, url, h, b: Response(200, json.dumps({"key": {"data": {"free_model_daily_requests": {"used": 1, "limit": 50}}}, "models": models, "zdr": {"data": [{"model_id": "a/one:free"}]}}[url.rsplit("/", 1)[-1]]))
    assert [(r.id, r.zdr) for r in inbox.free_models().collect()] == [("a/one:free", True)]
    said = inbox.setup()
    assert said == ["bot: bot", "model key works (free: 1 of 50 today)", "mails found: 3"] and len(inbox.triggers) == 1 and inbox.uninstall() == 1 and inbox.triggers == []
    inbox.channel.transport.answers = [(200, {"ok": True, "result": [{"message": {"chat": {"id": 5, "first_name": "A", "last_name": "B"}}}, {"message": {"chat": {"id": 5, "title": "T"}}}, {}]})]
    assert inbox.chat_ids() == [("5", "T")]
