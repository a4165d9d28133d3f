"""A cross-section of registered queries against their SQL twins, on the smallest tables.

``python check.py`` compares all of them.
"""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "label_articles", "rolling_thresholds", "closing_price", "next_close", "clean_documents", "clean_pages",
    "training_text", "benchmark_rows", "extraction_benchmarks", "trade_decisions", "recompute_trades",
    "settle_predictions", "repair_prices", "tracker_summary", "risk_ratios", "value_at_risk",
    "rolling_accuracy", "drawdown_curve", "quality_report", "live_signals", "history_signals",
    "assembled_predictions", "tfidf_vocabulary", "chi2_terms", "fold_sizes", "similar_articles",
    "replace_upsert", "merge_nonempty", "envelopes", "stream_daily_counts"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = contract.queries()[name](spark, FOLDER)
    result = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
