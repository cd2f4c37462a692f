"""A chain of language models behind one HTTP interface: each is asked in turn until one gives a usable answer."""

from __future__ import annotations

import json
import logging
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.plans.config import Settings
from sparkwarden.streaming.delivery import Response, Timers, Transport, request

log = logging.getLogger("sparkwarden")
#: Seconds that a call needs; the name of the pause; limits of error texts; a day's limit in an error text.
NEED, PAUSE_KEY, TEXT_LENGTH, RAW_LENGTH = 45, "llm.pause", 250, 150
PER_DAY = re.compile(r"per[- ]?day|daily|tages", re.IGNORECASE)


class ModelError(RuntimeError):
    """A model gave no answer; `fatal` ends the chain."""

    def __init__(self, message: str, status: int = 0, fatal: bool = False):
        super().__init__(message)
        self.status, self.fatal = status, fatal


def usable(content: str) -> bool:
    """Whether an answer holds a JSON object with an intent or a draft (operators.llm_reply reads it in full)."""
    text = re.sub(r"<think>[\s\S]*?</think>", "", content, flags=re.IGNORECASE)
    found = re.search(r"\{[\s\S]*\}", text)
    if not found:
        return False
    for candidate in (found.group(), re.sub(r",\s*([}\]])", r"\1", found.group())):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        return isinstance(value, dict) and any(isinstance(value.get(k), (str, int, float)) and str(value[k]).strip() for k in ("intent", "replyDraft"))
    return False


def error_text(error) -> str:
    """What an error object says."""
    if not error:
        return ""
    raw = (error.get("metadata") or {}).get("raw") if isinstance(error, dict) else None
    said = str((error.get("message") if isinstance(error, dict) else None) or json.dumps(error))
    return said[:TEXT_LENGTH] + (f" ({str(raw)[:RAW_LENGTH]})" if raw else "")


@dataclass
class Breaker:
    """A pause that all tasks share: a file for each time it was tripped, whose name says until when it lasts."""

    path: str
    clock: Callable[[], float] = time.time

    def _store(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.path) if ":/" in self.path else (pa.fs.LocalFileSystem(), self.path)

    def open(self) -> str | None:
        """Why nothing may be asked; None if it may."""
        fs, root = self._store()
        for f in fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith("until-") and int(f.base_name.split("-")[1]) > self.clock() * 1000:
                with fs.open_input_stream(f.path) as said:
                    return said.read().decode() or "paused"
        return None

    def trip(self, until: float, why: str) -> None:
        fs, root = self._store()
        fs.create_dir(root, recursive=True)
        draft = f"{root}/.draft-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(why.encode())
        fs.move(draft, f"{root}/until-{int(until * 1000)}-{uuid.uuid4().hex}")


def redacted(text: str, secrets: tuple[str, ...]) -> str:
    for s in secrets:
        if len(s) >= 8:
            text = text.replace(s, "***")
    return text


@dataclass
class ModelChain:
    """`base` is the interface's address, `key` its secret. A used-up quota starts a pause in which no model is asked."""

    transport: Transport
    base: str
    key: str
    cfg: Settings
    timers: Timers = field(default_factory=Timers)
    alert: Callable[[str, str, Exception | None], object] | None = None
    sleep: Callable[[float], None] = time.sleep

    def _headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.key}"}

    def paused(self) -> str | None:
        """Why the models are paused; null if they aren't."""
        return self.timers.why.get(PAUSE_KEY, "") if self.timers.running(PAUSE_KEY) else None

    def pause(self, seconds: float, why: str) -> None:
        self.timers.start(PAUSE_KEY, seconds, why)
        log.warning("models paused: %s", why)

    def clear(self) -> None:
        self.timers.end(PAUSE_KEY)

    def _until_reset(self, response: Response) -> float:
        value = {k.lower(): v for k, v in response.headers.items()}.get("x-ratelimit-reset")
        try:
            at = float(value)
        except (TypeError, ValueError):
            at = 0.0
        at = at / 1000 if at >= 1e12 else at
        return at - self.timers.clock() if at > self.timers.clock() else self.cfg.llm_cooldown_minutes * 60

    def _refused(self, response: Response) -> ModelError:
        body = response.json
        said = error_text(body.get("error")) if isinstance(body, dict) and body.get("error") else response.text[:200]
        if response.status == 401:
            return ModelError(f"key refused (401): {said}", 401, True)
        if response.status == 402:
            self.pause(self.cfg.llm_cooldown_minutes * 60, "kein Guthaben/Key-Limit (402)")
            return ModelError(f"no credit (402): {said}", 402, True)
        if response.status == 429 and PER_DAY.search(said):
            self.pause(self._until_reset(response), "Tageslimit der Gratis-Modelle")
            return ModelError(f"the day's limit is reached (429): {said}", 429, True)
        if response.status == 404:
            return ModelError(f"no such model (404): {said}", 404)
        return ModelError(f"HTTP {response.status}: {said}", response.status)

    def _body(self, model: str, system: str, user: str, simple: bool) -> dict:
        """A request; a simple one has neither a system role nor a JSON mode."""
        body = {"model": model, "temperature": self.cfg.llm_temperature, "max_tokens": self.cfg.llm_max_tokens}
        if self.cfg.llm_zdr_only:
            body["provider"] = {"zdr": True, "data_collection": "deny"}
        if simple:
            return body | {"messages": [{"role": "user", "content": f"{system}\n\n{user}"}]}
        if self.cfg.llm_reasoning_effort:
            body["reasoning"] = {"effort": self.cfg.llm_reasoning_effort, "exclude": True}
        return body | {"messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "response_format": {"type": "json_object"}}

    def _send(self, body: dict, deadline: float | None) -> tuple[str, str]:
        response = request(self.transport, "post", f"{self.base}/chat/completions", self._headers(), body, retries=1, retry_on=(500, 502, 503, 504), deadline=deadline, clock=self.timers.clock, sleep=self.sleep)
        if response.status != 200:
            raise self._refused(response)
        data = response.json
        if not isinstance(data, dict):
            raise ModelError("the answer is no JSON")
        choice = (data.get("choices") or [{}])[0]
        for error in (data.get("error"), choice.get("error")):
            if error:
                code = error.get("code") if isinstance(error, dict) else None
                raise ModelError(error_text(error), int(code) if str(code).isdigit() else 0)
        content = (choice.get("message") or {}).get("content")
        if not isinstance(content, str) or not content.strip():
            raise ModelError(f"an empty answer (finish_reason: {choice.get('finish_reason') or '?'})")
        return data.get("model") or body["model"], content

    def _time_left(self, deadline: float | None) -> bool:
        return deadline is None or deadline - self.timers.clock() >= NEED

    def ask(self, system: str, user: str, deadline: float | None = None) -> tuple[str, str]:
        """(model, content) of the first usable answer; ModelError if there is none. A 400 is tried once more in the simple form."""
        errors: list[str] = []
        for model in self.cfg.llm_models:
            if not self._time_left(deadline):
                errors.append("no time left")
                break
            try:
                try:
                    name, content = self._send(self._body(model, system, user, False), deadline)
                except ModelError as e:
                    if e.status != 400 or not self._time_left(deadline):
                        raise
                    name, content = self._send(self._body(model, system, user, True), deadline)
                if not usable(content):
                    raise ModelError("the answer can't be used")
                return name, content
            except (ModelError, OSError) as e:
                errors.append(f"{model.rsplit('/', 1)[-1].removesuffix(':free')}: {e}")
                log.warning("model %s failed: %s", model, e)
                if getattr(e, "fatal", False):
                    raise ModelError(" | ".join(errors), e.status, True) from e
        raise ModelError(" | ".join(errors) or "no models are set")

    def answers(self, system: str, prompts: list[str], deadline: float | None = None) -> dict[str, tuple[str | None, str | None]]:
        """Answers to a run's few prompts; a failure gives (None, None), and after a fatal one no more are asked."""
        out: dict[str, tuple[str | None, str | None]] = {}
        for p in prompts:
            if self.paused():
                break
            try:
                out[p] = self.ask(system, p, deadline)
            except ModelError as e:
                out[p] = (None, None)
                if e.fatal:
                    if self.alert:
                        self.alert(f"llm-{e.status or 'fatal'}", "no language model; rules only until further notice", e)
                    break
        return out

    def asked(self, df: DataFrame, system: str, prompt: str, in_flight: int, breaker: str, seconds: float | None = None) -> DataFrame:
        """df with llm_model, llm_content and llm_note for each prompt, asked by the executors: a bulk form of `answers`.

        At most `in_flight` prompts are asked at once, one in each of as many tasks; a prompt's models are tried in order. A used-up quota
        or a refused key opens a breaker, a file in the shared folder `breaker` that all tasks look at before each prompt: what is left
        gets its reason as a note and can be asked again later. `seconds` is how long a task may take. Null prompts aren't asked; a task
        that is repeated asks its prompts again. The chain has to be picklable; its alerts and kept timers stay with the driver.
        """
        chain = replace(self, alert=None, timers=Timers(clock=self.timers.clock))
        names = [f"c{k}" for k in range(len(df.columns))]
        flat = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)], F.col(f"`{prompt}`").alias("prompt"))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            deadline = chain.timers.clock() + seconds if seconds is not None else None
            shared = Breaker(breaker, chain.timers.clock)
            for batch in batches:
                for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    model = content = None
                    note = shared.open() if text is not None else ""
                    if text is not None and note is None:
                        try:
                            (model, content), note = chain.ask(system, text, deadline), ""
                        except ModelError as e:
                            note = redacted(str(e), (chain.key,))
                            if e.fatal:
                                shared.trip(chain.timers.until.get(PAUSE_KEY, chain.timers.clock() + chain.cfg.llm_cooldown_minutes * 60), note)
                    row = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([model], pa.string()), pa.array([content], pa.string()), pa.array([note], pa.string())], names=[*names, "model", "content", "note"])

        schema = ", ".join(f"{n} {flat.schema[n].dataType.simpleString()}" for n in names) + ", model string, content string, note string"
        out = flat.repartition(in_flight).mapInArrow(ask, schema)
        return out.select(*[F.col(n).alias(c) for c, n in zip(df.columns, names)], F.col("model").alias("llm_model"), F.col("content").alias("llm_content"), F.col("note").alias("llm_note"))

    def key_info(self) -> dict:
        response = request(self.transport, "get", f"{self.base}/key", self._headers(), sleep=self.sleep)
        if response.status != 200:
            raise self._refused(response)
        data = response.json or {}
        return data.get("data", data)

    def models(self) -> tuple[list[dict], list[str] | None]:
        """All models as rows for sources.messages.free_models, and the ids of those without data storage (null if that list is missing)."""
        response = request(self.transport, "get", f"{self.base}/models", sleep=self.sleep)
        if response.status != 200 or not isinstance(response.json, dict):
            raise ModelError(f"no list of models (HTTP {response.status})", response.status)
        number = lambda x: float(x) if x not in (None, "") else None
        rows = [{"id": m["id"], "context": m.get("context_length"), "prompt_price": number((m.get("pricing") or {}).get("prompt")), "completion_price": number((m.get("pricing") or {}).get("completion")), "outputs": (m.get("architecture") or {}).get("output_modalities"), "parameters": m.get("supported_parameters") or []} for m in response.json.get("data") or []]
        try:
            zdr = request(self.transport, "get", f"{self.base}/endpoints/zdr", sleep=self.sleep)
            listed = [e["model_id"] for e in zdr.json["data"] if e.get("model_id")] if zdr.status == 200 else None
        except (OSError, KeyError, TypeError):
            listed = None
        return rows, listed
