"""What an operator of the inbox calls: runs, set-up, diagnosis, samples, reset. All outside contacts are arguments."""

from __future__ import annotations

import json
import logging
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkwarden.functions import text as T
from sparkwarden.operators import heuristics, pipeline, risk
from sparkwarden.plans import config
from sparkwarden.plans.config import Settings
from sparkwarden.sources import messages
from sparkwarden.streaming import delivery
from sparkwarden.streaming.channel import Alerts, Channel, set_up_log
from sparkwarden.streaming.delivery import Box, FatalError, Timers
from sparkwarden.streaming.model_client import ModelChain
from sparkwarden.streaming.store import Fenced

log = logging.getLogger("sparkwarden")
#: Invented mails that show a haggling buyer, a courier fraud and a false payment page.
SAMPLES = (
    ("preis", '"Jana über Kleinanzeigen" <j-1@mail.kleinanzeigen.de>', "Nutzer-Anfrage zu deiner Anzeige „Herrenrad 28 Zoll“", "Jana hat dir eine Nachricht zu deiner Anzeige geschickt:\n\nHallo, ist das Rad noch da? Würdest du es für 120 € abgeben? Ich könnte es am Sonntag abholen und bar bezahlen."),
    ("kurier", '"Tom über Kleinanzeigen" <t-2@mail.kleinanzeigen.de>', "Nutzer-Anfrage zu deiner Anzeige „Spielkonsole“", "Tom hat dir eine Nachricht zu deiner Anzeige geschickt:\n\nIch kaufe ungesehen. Ich bin gerade im Ausland, mein Kurier kommt vorbei, das Geld wurde bereits überwiesen. Schreib mir auf WhatsApp: +44 7700 900456"),
    ("zahlseite", '"Mia über Kleinanzeigen" <m-3@mail.kleinanzeigen.de>', "Nutzer-Anfrage zu deiner Anzeige „Kinderwagen“", "Mia hat dir eine Nachricht zu deiner Anzeige geschickt:\n\nDer Betrag ist bereits hinterlegt. Um das Geld zu empfangen, bestätige hier: https://kleinanzeigen-zahlung.shop/e/1"),
)
FOOTER = "\n\nAntworten\n\nSicherheitshinweis: Gib keine Codes weiter.\nKleinanzeigen GmbH"


def samples(spark: SparkSession, now: datetime | None = None) -> DataFrame:
    """The sample mails in the form of messages.MAIL."""
    at = now or datetime.now(UTC)
    rows = [(f"sample-{k}", "sample", subject, sender, "", at, "Hallo,\n\n" + body + FOOTER, "", "") for k, (_, sender, subject, body) in enumerate(SAMPLES)]
    return spark.createDataFrame(rows, messages.MAIL)


@dataclass
class Inbox:
    """One inbox: `mails` gives the mails there are, `box` keeps what is pending and done, `channel` gets notifications, `chain` may be
    None. `mark` and `draft` act on the mail's own store after a send (processed; a reply as a draft); `failed` after giving up."""

    spark: SparkSession
    box: Box
    channel: Channel
    cfg: Settings
    mails: Callable[[], DataFrame]
    chain: ModelChain | None = None
    timers: Timers = field(default_factory=Timers)
    mark: Callable[[dict], None] | None = None
    draft: Callable[[dict, str], None] | None = None
    failed: Callable[[str], None] | None = None

    def __post_init__(self) -> None:
        """Timers live in the outbox, so pauses and throttles outlive the process; all parts share them."""
        set_up_log(self.cfg)
        self.timers.load(self.box.log.head().timers)
        self.timers.keep = self.box.keep_timers
        if self.chain:
            self.chain.timers = self.timers

    @property
    def alerts(self) -> Alerts:
        return Alerts(self.channel, self.cfg, self.timers)

    def _wanted(self, days: int | None = None) -> DataFrame:
        return messages.wanted(self.mails(), self.cfg.sender_domains, F.current_timestamp(), days or self.cfg.newer_than_days, self.cfg.sender_subject_pattern, subject_domains=self.cfg.subject_sender_domains)

    def _asked(self, ids: list[str], mails: DataFrame, deadline: float | None, answers: dict) -> list[str]:
        """The ids of a run's few mails for which there is time, in order and at least one; the models' answers to them go to `answers`."""
        prompts: dict[str, str | None] = {}
        if self.chain and self.cfg.llm_enabled:
            self.chain.alert = self.alerts.error
            if self.chain.paused() is None:
                prompts = {r["id"]: r["prompt"] for r in pipeline.prompts(mails, self.cfg, None).collect()}
        admitted: list[str] = []
        for i in ids:
            if admitted and deadline is not None and deadline - self.timers.clock() < delivery.RESERVE:
                break
            if prompts.get(i):
                answers |= self.chain.answers(pipeline.system_prompt(self.cfg), [prompts[i]], deadline)
            admitted.append(i)
        return admitted

    def _prepared(self, mails: DataFrame, answers: dict | None = None, test: bool = False) -> DataFrame:
        """Results of a run's few mails, with the models' answers; without any, all of them are asked first."""
        if answers is None:
            answers = {}
            self._asked([r["id"] for r in mails.select("id").collect()], mails, None, answers)
        paused, client = None, None
        if self.chain and self.cfg.llm_enabled:
            paused = None if answers else self.chain.paused()
            client = lambda system, prompt: answers.get(prompt, (None, None))
        return pipeline.process(mails, self.cfg, client, test, paused)

    def _send(self, row: dict) -> None:
        self.channel.send(row["notification"], json.loads(row["buttons"]) if row["buttons"] else None, row["silent"], row["plain_only"])

    def _after(self, row: dict) -> None:
        if self.mark:
            try:
                self.mark(row)
            except Exception as e:  # noqa: BLE001
                log.warning("%s could not be marked: %s", row["id"], e)
        if self.cfg.create_drafts and self.draft and row["level"] != "HIGH":
            self.draft(row, row["reply"])

    def _given_up(self, key: str, title: str, err: Exception | None) -> None:
        if self.failed and key.startswith("giveup-"):
            try:
                self.failed(key.removeprefix("giveup-"))
            except Exception as e:  # noqa: BLE001
                log.warning("%s could not be marked as failed: %s", key, e)
        self.alerts.error(key, title, err)

    def run(self, offer: bool = True) -> dict | None:
        """One run over what is wanted and pending; None if another run is at work, or if it failed and an alert was given.

        Fatal failures of the channel or the settings are raised, as no alert could be sent.
        """
        lease = self.box.log.acquire(2 * self.cfg.max_runtime_seconds)
        if lease is None:
            log.info("another run is at work")
            return None
        try:
            self.timers.load(self.box.log.head().timers)
            deadline, answers = self.timers.clock() + self.cfg.max_runtime_seconds, {}
            if offer:
                self.box.offer(messages.to_input(self._wanted()).join(self.box.known(), "id", "left_anti"))
            return delivery.deliver(self.box, lease, lambda m: pipeline.screened(m, self.cfg), lambda m: self._prepared(m, answers), self._send, self.cfg, self.timers, self._given_up, self._after, deadline, lambda ids, m: self._asked(ids, m, deadline, answers))
        except (FatalError, config.FatalSettings):
            raise
        except Fenced as e:
            log.error("the run took too long, another one went on: %s", e)
            return None
        except Exception as e:  # noqa: BLE001
            self.alerts.error("run", "the run was stopped", e)
            return None
        finally:
            self.box.log.release(lease)

    def setup(self) -> list[str]:
        """Check settings and contacts, and install the trigger; what was found. Settings that can't work raise FatalSettings."""
        if problems := config.validate(self.cfg):
            raise config.FatalSettings("; ".join(problems))
        said = [f"bot: {self.channel.me().get('username')}"]
        if self.chain and self.cfg.llm_enabled:
            info = self.chain.key_info()
            daily = info.get("free_model_daily_requests") or {}
            said.append(f"model key works{' (free: %s of %s today)' % (daily.get('used'), daily.get('limit')) if daily else ''}")
            try:
                free = {r["id"]: r["zdr"] for r in self.free_models().collect()}
                said += [f"not free any more: {m}" for m in self.cfg.llm_models if m not in free]
                said += [f"stores data, so is never used: {m}" for m in self.cfg.llm_models if self.cfg.llm_zdr_only and free.get(m) is False]
            except Exception as e:  # noqa: BLE001
                said.append(f"models could not be listed: {e}")
        said.append(f"mails found: {self._wanted().count()}")
        self.uninstall()
        self.install()
        self.channel.send(f"✅ <b>Sparkwarden ist aktiv.</b>\nGeprüft wird alle {self.cfg.trigger_minutes} Minuten.")
        return said

    @property
    def triggers(self) -> list[StreamingQuery]:
        """The running triggers of this inbox."""
        return [q for q in self.spark.streams.active if q.name == self._trigger_name]

    @property
    def _trigger_name(self) -> str:
        return f"sparkwarden_{zlib.crc32(self.box.path.encode()):08x}"

    def install(self) -> StreamingQuery:
        """Start a run every trigger_minutes, for as long as the session lives; a fatal failure ends the query and is its exception."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

        def tick(_: DataFrame, __: int) -> None:
            self.run()

        return ticks.writeStream.queryName(self._trigger_name).foreachBatch(tick).trigger(processingTime=f"{self.cfg.trigger_minutes} minutes").start()

    def uninstall(self) -> int:
        """Stop the triggers; how many there were."""
        running = self.triggers
        for q in running:
            q.stop()
        return len(running)

    def chat_ids(self) -> list[tuple[str, str]]:
        """Chats that wrote to the bot: id and name, the last name given counts."""
        found: dict[str, str] = {}
        for u in self.channel.updates():
            chat = next((u[k].get("chat") for k in ("message", "channel_post", "edited_message", "my_chat_member") if u.get(k)), None)
            if chat:
                name = chat.get("title") or " ".join(x for x in (chat.get("first_name"), chat.get("last_name")) if x) or chat.get("username") or chat.get("type") or ""
                found[str(chat["id"])] = name
        return list(found.items())

    def send_samples(self) -> list[tuple[str, str, str, str]]:
        """Send the samples' notifications as tests: name, level, intent and the reply's source of each. Nothing is stored."""
        rows = {r["id"]: r.asDict(recursive=True) for r in self._prepared(samples(self.spark), test=True).collect()}
        out = []
        for k, (name, *_) in enumerate(SAMPLES):
            row = rows[f"sample-{k}"]
            self._send(row)
            out.append((name, row["level"], row["intent"], row["reply_source"]))
        return out

    def test_latest(self) -> tuple[str, str] | None:
        """Send the newest wanted mail's notification as a test, done or not: level and the reply's source; None without mails."""
        rows = self._prepared(messages.latest(self._wanted(36500)), test=True).collect()
        if not rows:
            return None
        self._send(rows[0].asDict(recursive=True))
        return rows[0]["level"], rows[0]["reply_source"]

    def explain_latest(self) -> dict | None:
        """How the newest wanted mail is read and rated: raw and extracted text, what a model would see, findings and guesses."""
        names = F.array("sender_name")
        rated = heuristics.with_heuristics(risk.evaluate(pipeline.screened(messages.latest(self._wanted(36500)), self.cfg), keep_context=True))
        shown = rated.select(
            "subject", "platform_name", "sender_name", "listing_title", "listing_url", "skip_reason", "extraction", T.truncate(F.col("raw_body"), 3000).alias("raw_body"), "text", pipeline.sanitized(F.col("text"), self.cfg.llm_max_input_chars, names).alias("for_model"),
            "level", "score", "findings", "guess_intent", "guess_price", "guess_logistics", "guess_payment",
        )
        row = shown.first()
        return row.asDict(recursive=True) if row else None

    def free_models(self) -> DataFrame:
        """Models that cost nothing, those without data storage first."""
        rows, zdr = self.chain.models()
        models = self.spark.createDataFrame([tuple(r.values()) for r in rows], "id string, context long, prompt_price double, completion_price double, outputs array<string>, parameters array<string>")
        return messages.free_models(models, None if zdr is None else self.spark.createDataFrame([(i,) for i in zdr], "model_id string"))

    def reset(self) -> None:
        """Forget what was delivered, and end a pause of the models."""
        self.box.reset()
        if self.chain:
            self.chain.clear()
