"""The driver's contract, and queries against their SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["q_extract_emails", "q_extract_phones", "q_normalize_squash", "q_escape_html", "q_host_of_pages", "q_truncate", "q_parse_number", "q_format_euro", "q_candidates_anti_done", "q_done_fifo400", "q_alert_throttle", "q_heuristic_payment", "q_heuristic_logistics", "q_attempts_giveup", "q_run_stats", "q_one_line", "q_strip_tags", "q_redact_secrets", "q_risk_scores", "q_rule_hits"]


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want
