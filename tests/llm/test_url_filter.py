"""URL rules against a plain version: subdomains, longest rules, odd URLs, long lists, filters that let all pass or nothing."""

import random

import pytest

from sparkwarden.llm import url_filter

ODD = [
    None, "", "no scheme/x", "http://", "http://org", "http://org/", "HTTP://EXAMPLE.ORG/es/1", "http://a.Example.org/es", "http://a.example.org/es/", "http://notexample.org/es/", "http://example.org/en/12?x=/es/",
    "http://x.com/de/#/fr/", "http://x.com/fr/a", "http://x.com?/de/", "http://x.com#://y.org/", "http://com/de/", "a://b://x.com/de/", "http://x.com:80/de/", "http://ÄÖ.example.org/es/é", "http://.org/", "http://x..org/a\nb", "//x.com/de/",
    "http://x.org/" + "a" * 70000, "http://" + "s." * 3000 + "com/de/x", "http://x.net/de/", "http://u@x.com/de/",
]


def judged(spark, urls, rules, **more):
    rows = [(k, u, "clash", "clash", 7) for k, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, _sw_id int").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.rules_of(spark, rules), **more).collect()}
    return [got[k] for k in range(len(urls))]


def test_rules_of_the_query(spark):
    assert judged(spark, ODD, url_filter.RULES) == url_filter.brute_force(ODD, url_filter.RULES)
    assert judged(spark, ODD, url_filter.RULES, default="block") == url_filter.brute_force(ODD, url_filter.RULES, "block")


@pytest.mark.parametrize("way", ["broadcast", "shuffle", "heavy", "full", "many keys"])
def test_long_lists(spark, monkeypatch, way):
    draw = random.Random(3)
    names = ["a", "b", "c", "com", "org"]
    host = lambda: ".".join(draw.choice(names) for _ in range(draw.randint(1, 4)))
    path = lambda: "".join(draw.choice(["/", "x", "y"]) for _ in range(draw.randint(0, 5)))
    rules = tuple({(h, p): (h, p, draw.choice(["allow", "block"])) for h, p in ((host(), "/" + path() if draw.random() < 0.8 else "") for _ in range(150))}.values())
    urls = [f"http://{host()}/{path()}" for _ in range(400)] + ["http://a.com/xx"] * 100 + [None, f"http://{host()}"]
    if way != "broadcast":
        monkeypatch.setattr(url_filter, "FEW_RULES", 0)
    monkeypatch.setattr(url_filter, "HEAVY_ROWS", 50 if way == "heavy" else 10**6)
    if way == "full":
        monkeypatch.setattr(url_filter, "MOST", 1)
    if way == "many keys":
        monkeypatch.setattr(url_filter, "PROBES", 1)
    assert judged(spark, urls, rules) == url_filter.brute_force(urls, rules)


def test_repeated_rows_empty_tables_and_useless_rules(spark):
    schema = "page_id long, url string"
    rules = [("ORG", "/", "allow"), ("org", "/", "block"), (None, "/", "block"), ("com", None, "block"), ("com", "/", None), ("com", "x", "block"), ("net", "/", "perhaps")]
    df = spark.createDataFrame([(1, "http://x.org/")] * 3 + [(None, "http://x.org/"), (None, None), (1, "http://x.com/"), (2, "http://x.net/")], schema)
    got = sorted(map(str, url_filter.judge(df, spark.createDataFrame(rules, url_filter.RULE)).select("page_id", "rule", "verdict").collect()))
    assert got == sorted(["Row(page_id=1, rule='org/', verdict='block')"] * 3 + ["Row(page_id=None, rule='org/', verdict='block')", "Row(page_id=None, rule=None, verdict='allow')", "Row(page_id=1, rule=None, verdict='allow')", "Row(page_id=2, rule=None, verdict='allow')"])
    assert url_filter.judge(df.limit(0), url_filter.rules_of(spark)).count() == 0
    assert {r.verdict for r in url_filter.judge(df, url_filter.rules_of(spark).limit(0)).collect()} == {"allow"}


def test_the_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as key")
    bits = url_filter.bloom(keys, 2048).collect()[0].bits
    assert len(bits) == 2048
    from pyspark.sql import functions as F

    ask = lambda df: df.where(url_filter._maybe(F.col("key"), F.array(*map(F.lit, bits)), 2048)).count()
    assert ask(keys) == 5000 and ask(spark.range(5000).selectExpr("concat('other', id) as key")) < 250


def test_no_python_and_no_shuffle_of_rows_that_no_rule_can_fit(spark):
    df = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    plan = url_filter.judge(df, url_filter.rules_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
