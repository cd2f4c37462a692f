"""Platforms by a join equal the catalog's expression; they change with the table's rows alone."""

import itertools

from pyspark.sql import functions as F

from sparkwarden.operators import parse, platforms
from sparkwarden.plans.catalog import PLATFORMS


def test_the_join_equals_the_catalog(spark):
    hosts = ["kleinanzeigen.de", "mail.kleinanzeigen.de", "xkleinanzeigen.de", "kleinanzeigen.de.evil.org", "willhaben.at", "a.b.ebay.com", "ebay.de.", ".ebay.de", "EBAY.ch", "", "x", "..", "a-b.ebay-kleinanzeigen.de"]
    rows = [(k, f"N <n@{a}>", f"r@{b}" if b != "x" else None, "clash") for k, (a, b) in enumerate(itertools.product(hosts, hosts))] + [(900, None, None, "clash"), (901, "a@willhaben.at b@ebay.de", "", "clash"), (901, "a@willhaben.at b@ebay.de", "", "clash")]
    df = spark.createDataFrame(rows, "k int, sender string, reply_to string, id string")
    joined = platforms.with_platform(df, platforms.platform_table(spark))
    want = df.withColumn("platform", parse.detect_platform(F.col("sender"), F.col("reply_to")))
    assert joined.columns == want.columns and sorted(map(tuple, joined.fillna("").collect())) == sorted(map(tuple, want.fillna("").collect()))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert {r.platform for r in joined.collect()} == {p.id for p in PLATFORMS}


def test_platforms_are_data(spark):
    df = spark.createDataFrame([(1, "a@shop.example", ""), (2, "a@b.shop.example", None), (3, "a@other", "")], "k int, sender string, reply_to string")
    table = spark.createDataFrame([(1, "new", ".Shop.example"), (1, "later", "shop.example"), (0, "none", ""), (0, None, "other"), (None, "x", "other")], platforms.PLATFORM)
    assert [r.platform for r in platforms.with_platform(df, table).orderBy("k").collect()] == ["later", "later", "generic"]
    assert {r.platform for r in platforms.with_platform(df, table.limit(0)).collect()} == {"generic"}
    mails = df.withColumns({c: F.lit("") for c in ("id", "thread_id", "subject", "plain_body", "html_body", "permalink")} | {"received_at": F.current_timestamp()})
    assert {r.platform for r in parse.parse(platforms.with_platform(mails, table), detected=True).collect()} == {"later", "generic"}
