"""Prompts asked by tasks: how many at once, models in order, one breaker for all, notes, odd rows."""

import json
import time
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from sparkwarden.plans.config import Settings
from sparkwarden.streaming.delivery import Response
from sparkwarden.streaming.model_client import Breaker, ModelChain

GOOD = json.dumps({"intent": "KAUFINTERESSE"})


class Service:
    """Answers by model, and notes each call with its time; the prompt `stop` uses the quota up."""

    def __init__(self, root, fatal=402):
        self.root, self.fatal = str(root), fatal

    def __call__(self, method, url, headers, body):
        began, prompt = time.time(), body["messages"][-1]["content"]
        time.sleep(0.002)
        (Path(self.root) / uuid.uuid4().hex).write_text(json.dumps([prompt, body["model"], began, time.time()]))
        if prompt == "stop":
            time.sleep(0.05)
            return Response(self.fatal, json.dumps({"error": {"message": "no credit for secretkey"}}))
        good = body["model"] == "b/two" or prompt.endswith("0")
        return Response(200, json.dumps({"model": body["model"], "choices": [{"message": {"content": GOOD if good else "nothing"}}]}))

    def calls(self):
        return sorted((json.loads(f.read_text()) for f in Path(self.root).iterdir()), key=lambda c: c[2])


def chain(service):
    return ModelChain(service, "https://m", "secretkey", Settings(llm_models=("a/one", "b/two")))


def test_a_thousand_prompts(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    service = Service(tmp_path / "calls")
    df = spark.range(1000).select("id", F.concat(F.lit("p"), "id").alias("prompt"), F.lit("x").alias("model"), F.lit(1).alias("c0")).union(spark.createDataFrame([(5000, None, "x", 1)], "id long, prompt string, model string, c0 int"))
    got = chain(service).asked(df, "s", "prompt", 3, str(tmp_path / "breaker")).collect()
    calls = service.calls()
    assert len(got) == 1001 and all(r.llm_content == GOOD and r.llm_model == ("a/one" if r.id % 10 == 0 else "b/two") and r.llm_note == "" and r.model == "x" for r in got if r.prompt)
    assert [(r.llm_content, r.llm_note) for r in got if r.prompt is None] == [(None, "")]
    tried = {}
    for prompt, model, *_ in calls:
        tried.setdefault(prompt, []).append(model)
    assert all(m == (["a/one"] if p.endswith("0") else ["a/one", "b/two"]) for p, m in tried.items()) and len(tried) == 1000
    edges = sorted([(c[2], 1) for c in calls] + [(c[3], -1) for c in calls], key=lambda e: (e[0], e[1]))
    most = now = 0
    for _, step in edges:
        now += step
        most = max(most, now)
    assert most <= 3


def test_one_breaker_for_all_tasks(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    service, path = Service(tmp_path / "calls"), str(tmp_path / "breaker")
    df = spark.createDataFrame([(k, "stop" if k % 5 == 1 else f"p{k}0") for k in range(300)], "id int, prompt string")
    first = chain(service).asked(df, "s", "prompt", 4, path).collect()
    assert 1 <= sum(c[0] == "stop" for c in service.calls()) <= 4  # no task goes on behind another's failure
    notes = [r.llm_note for r in first if r.llm_content is None]
    assert len(notes) > 200 and all("402" in n and "secretkey" not in n for n in notes)
    before = len(service.calls())
    again = chain(service).asked(df, "s", "prompt", 4, path).collect()
    assert len(service.calls()) == before and all(r.llm_content is None and "402" in r.llm_note for r in again)
    assert Breaker(path, lambda: time.time() + 7 * 3600).open() is None
    assert chain(service).asked(df.limit(0), "s", "prompt", 4, path).count() == 0
