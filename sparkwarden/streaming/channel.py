"""The channel that notifications go to (a bot's HTTP interface), and alerts about the operation."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from sparkwarden.plans.config import Settings
from sparkwarden.streaming.delivery import FatalError, Timers, Transport, request

log = logging.getLogger("sparkwarden")
#: Statuses and descriptions with which another try is useless; the longest wait; the length of a plain text.
FATAL_STATUS = (401, 403, 404)
FATAL_TEXT = re.compile(r"chat not found|bot was blocked|user is deactivated|bot was kicked", re.IGNORECASE)
LONGEST_WAIT, PLAIN_LENGTH, DETAIL_LENGTH = 30, 4000, 500
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&amp;": "&"}


class ChannelError(RuntimeError):
    """The channel refused; `status` is its answer's."""

    def __init__(self, message: str, status: int):
        super().__init__(message)
        self.status = status


class ChannelFatal(ChannelError, FatalError):
    """The channel refuses everything."""


def redacted(text: str, secrets: tuple[str, ...] = ()) -> str:
    """A line for logs and alerts without secrets, bot tokens and keys."""
    for s in secrets:
        if len(s) >= 8:
            text = text.replace(s, "***")
    return re.sub(r"sk-or-[A-Za-z0-9_-]{10,}", "sk-or-***", re.sub(r"bot[0-9]{5,}:[A-Za-z0-9_-]{20,}", "bot***", text))


class Redacting(logging.Filter):
    """Takes secrets out of every line before any handler sees it, exceptions included."""

    def __init__(self, secrets: tuple[str, ...] = ()):
        super().__init__()
        self.secrets = secrets

    def filter(self, record: logging.LogRecord) -> bool:
        said = record.getMessage()
        if record.exc_info:
            said += "\n" + logging.Formatter().formatException(record.exc_info)
            record.exc_info = record.exc_text = None
        record.msg, record.args = redacted(said, self.secrets), ()
        return True


def set_up_log(cfg: Settings) -> None:
    """The level of the settings, and one filter that knows their secrets."""
    level = logging.getLevelName(cfg.log_level.upper())
    log.setLevel(level if isinstance(level, int) else logging.INFO)
    for f in [f for f in log.filters if isinstance(f, Redacting)]:
        log.removeFilter(f)
    log.addFilter(Redacting(tuple(v for k, v in cfg.secrets.items() if k != "chat_id")))


def escaped(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(a, b)
    return text


def plain(text: str) -> str:
    """A marked-up text without its marks, cut to what the channel takes."""
    bare = re.sub(r"&(?:lt|gt|quot|amp);", lambda m: ENTITIES[m.group()], re.sub(r"<[^>]+>", "", text))
    return bare if len(bare) <= PLAIN_LENGTH else bare[: PLAIN_LENGTH - 1] + "…"


@dataclass
class Channel:
    """`base` is the address with the secret part; `chat` is who gets the messages."""

    transport: Transport
    base: str
    chat: str
    sleep: Callable[[float], None] = time.sleep

    def call(self, method: str, payload: dict | None = None) -> object:
        """The result of a method. Busy servers are tried again; a flood limit is waited for, twice at most."""
        for attempt in range(3):
            response = request(self.transport, "post", f"{self.base}/{method}", None, payload or {}, retries=2, retry_on=(500, 502, 503, 504), sleep=self.sleep)
            body = response.json if isinstance(response.json, dict) else {}
            if body.get("ok"):
                return body.get("result")
            wait = (body.get("parameters") or {}).get("retry_after")
            if response.status == 429 and wait and wait <= LONGEST_WAIT and attempt < 2:
                self.sleep(wait)
                continue
            said = body.get("description") or f"HTTP {response.status}"
            kind = ChannelFatal if response.status in FATAL_STATUS or FATAL_TEXT.search(said) else ChannelError
            raise kind(f"{method}: {said}", response.status)
        raise AssertionError

    def send(self, text: str, buttons: object = None, silent: bool = False, plain_only: bool = False) -> object:
        """Send a message; if its marks or buttons are refused (400), send its plain text without buttons."""
        payload = {"chat_id": self.chat, "text": text, "link_preview_options": {"is_disabled": True}, "disable_notification": bool(silent)}
        full = payload | ({} if plain_only else {"parse_mode": "HTML"}) | ({"reply_markup": buttons} if buttons else {})
        try:
            return self.call("sendMessage", full)
        except ChannelFatal:
            raise
        except ChannelError as e:
            if e.status != 400 or plain_only:
                raise
            log.warning("marks or buttons were refused (%s); sending plain text", e)
            return self.call("sendMessage", payload | {"text": plain(text)})

    def me(self) -> dict:
        return self.call("getMe")

    def updates(self) -> list[dict]:
        return self.call("getUpdates", {"limit": 50, "timeout": 0}) or []


@dataclass
class Alerts:
    """Messages about the operation, one per key and alert_throttle_minutes at most; that one can't be sent never stops anything."""

    channel: Channel
    cfg: Settings
    timers: Timers

    def error(self, key: str, title: str, err: Exception | None = None) -> bool:
        detail = redacted(str(err), tuple(self.cfg.secrets.values())) if err else ""
        log.error("%s: %s", title, detail)
        if not self.timers.allow(f"alert.{key}", self.cfg.alert_throttle_minutes * 60):
            return False
        try:
            self.channel.send("⚠️ <b>Sparkwarden</b>\n" + escaped(title) + (f"\n<code>{escaped(detail[:DETAIL_LENGTH])}</code>" if detail else ""))
        except Exception as e:  # noqa: BLE001
            log.error("the alert could not be sent: %s", redacted(str(e)))
            return False
        return True
