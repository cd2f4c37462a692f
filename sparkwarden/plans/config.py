"""Settings with defaults, read from texts (environment, files, tables)."""

from __future__ import annotations

import json
import logging
import re
from dataclasses import dataclass, field, fields, replace

log = logging.getLogger("sparkwarden")


@dataclass(frozen=True)
class Settings:
    """The defaults."""

    sender_domains: tuple[str, ...] = ("kleinanzeigen.de", "willhaben.at")
    subject_sender_domains: tuple[str, ...] = ("ebay.de", "ebay.at", "ebay.com")
    sender_subject_pattern: str = r"\b(nachricht|nachrichten|frage|message|question)\b"
    newer_than_days: int = 7
    max_threads_per_run: int = 10
    max_messages_per_run: int = 8
    skip_subject_patterns: tuple[str, ...] = (
        "suchauftrag", "neue anzeigen für", "l(ä|ae)uft (bald )?ab", "ist abgelaufen", "wurde (veröffentlicht|gelöscht|deaktiviert|verlängert)", "newsletter", "deine rechnung", "bewerte (jetzt )?", "passwort", "bestätige deine",
    )
    create_drafts: bool = False
    allowed_link_domains: tuple[str, ...] = ()
    llm_enabled: bool = True
    llm_models: tuple[str, ...] = ("qwen/qwen3.8-27b:free", "inclusionai/ling-3.0-flash-sante:free", "openrouter/free")
    llm_temperature: float = 0.2
    llm_max_tokens: int = 1500
    llm_max_input_chars: int = 2500
    llm_skip_on_high_rule_risk: bool = True
    llm_cooldown_minutes: int = 60
    llm_zdr_only: bool = True
    llm_reasoning_effort: str = "low"
    seller_name: str = ""
    seller_context: str = ""
    form_of_address: str = "du"
    silent_low_risk: bool = False
    trigger_minutes: int = 5
    max_runtime_seconds: int = 270
    max_delivery_attempts: int = 5
    alert_throttle_minutes: int = 60
    log_level: str = "INFO"
    secrets: dict[str, str] = field(default_factory=dict)

    @property
    def formal(self) -> bool:
        return self.form_of_address.lower() == "sie"


#: Secrets without which nothing can be sent, and the one that language models need.
REQUIRED, MODEL_KEY = ("bot_token", "chat_id"), "model_key"


def secret(s: Settings, name: str) -> str:
    """A secret; a missing one is fatal."""
    if not s.secrets.get(name):
        raise FatalSettings(f"{name} is missing")
    return s.secrets[name]


class FatalSettings(RuntimeError):
    """Settings with which nothing can run."""


def coerce(raw: str | None, default):
    """A text as the type of the default; blank or unusable texts give the default."""
    text = (raw or "").strip()
    if not text:
        return default
    if isinstance(default, bool):
        return text.lower() in ("true", "1", "ja", "yes", "on")
    if isinstance(default, (int, float)):
        try:
            value = float(text)
        except ValueError:
            log.warning("not a number: %r", raw)
            return default
        return int(value) if isinstance(default, int) and value.is_integer() else value
    if isinstance(default, tuple):
        if text.startswith("["):
            try:
                return tuple(str(x) for x in json.loads(text))
            except ValueError:
                pass
        return tuple(x.strip() for x in re.split(r"[,\n]", text) if x.strip())
    return text


def load(properties: dict[str, str] | None = None) -> Settings:
    """Settings with overrides by name, upper or lower case."""
    given = {k.lower(): v for k, v in (properties or {}).items()}
    base = Settings()
    secrets = {k: given[k].strip() for k in (*REQUIRED, MODEL_KEY) if (given.get(k) or "").strip()}
    return replace(base, secrets=secrets, **{f.name: coerce(given[f.name], getattr(base, f.name)) for f in fields(base) if f.name in given and f.name != "secrets"})


def validate(s: Settings) -> list[str]:
    """What is wrong with settings; empty if nothing is."""
    out = [f"{name} is missing" for name in REQUIRED if not s.secrets.get(name)]
    if s.secrets.get("chat_id") and not re.fullmatch(r"-?[0-9]+", s.secrets["chat_id"]):
        out.append("chat_id must be a number")
    if s.llm_enabled and not s.secrets.get(MODEL_KEY):
        out.append(f"{MODEL_KEY} is missing")
    if s.llm_enabled and not s.llm_models:
        out.append("llm_models is empty")
    if s.trigger_minutes not in (1, 5, 10, 15, 30):
        out.append("trigger_minutes must be 1, 5, 10, 15 or 30")
    if not 60 <= s.max_runtime_seconds <= 330:
        out.append("max_runtime_seconds must be between 60 and 330")
    if s.llm_enabled and s.form_of_address.lower() not in ("du", "sie"):
        out.append("form_of_address must be du or sie")
    for p in s.skip_subject_patterns:
        try:
            re.compile(p)
        except re.error as e:
            out.append(f"skip_subject_patterns: {p!r}: {e}")
    return out
