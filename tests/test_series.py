"""Thresholds, alignment, as-of lookups and labels on hand-made series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsignal.operators import asof, labels, prices

D = dt.date
PRICES = "date date, symbol string, price double, pct_change_24h double"


def day(n):
    return D(2024, 1, 1) + dt.timedelta(days=n)


def series(spark, rows):
    return spark.createDataFrame(rows, PRICES)


def test_thresholds_need_thirty_observations_and_restart_after_a_gap(spark):
    rows = [(day(n), "A", 1.0, float(n % 7) / 2) for n in range(31)]
    rows.append((day(200), "A", 1.0, 2.0))
    got = {r["date"]: (r["thresh_low"], r["thresh_high"]) for r in prices.with_thresholds(series(spark, rows)).collect()}
    assert got[day(28)] == (1.0, 3.0)
    assert got[day(29)] != (1.0, 3.0)
    assert got[day(200)] == (1.0, 3.0)


def test_missing_changes_do_not_count(spark):
    rows = [(day(n), "A", 1.0, None if n == 0 else 1.0) for n in range(30)]
    got = {r["date"]: r["thresh_high"] for r in prices.with_thresholds(series(spark, rows)).collect()}
    assert got[day(29)] == 3.0  # 29 observations only


@pytest.mark.parametrize("pct,expected", [(3.0, "HIGH"), (-1.0, "MEDIUM"), (0.99, "LOW"), (-25.0, "HIGH")])
def test_labels_at_the_threshold(spark, pct, expected):
    row = spark.createDataFrame([(pct,)], "p double").select(prices.fixed_label(F.col("p")).alias("l")).first()
    assert row["l"] == expected


def test_cap_applies_to_the_size(spark):
    row = spark.createDataFrame([(25.0,)], "p double").select(
        prices.rolling_label(F.col("p"), F.lit(1.0), F.lit(20.5)).alias("l")).first()
    assert row["l"] == "MEDIUM"


def test_alignment_gap(spark):
    rows = [(day(n), "A", 1.0, 1.0) for n in (10, 20, 21, 22, 23)]
    calendar = {r["probe_date"]: r["aligned_date"] for r in asof.trading_calendar(series(spark, rows)).collect()}
    assert calendar[day(7)] == day(10) and day(6) not in calendar
    few = {r["probe_date"] for r in asof.trading_calendar(series(spark, rows[:4])).collect()}
    assert few == {day(10), day(20), day(21), day(22)}


def lookups(spark, tier1, tier2, after=False):
    rows = spark.createDataFrame([(1, day(0), "A", "T")],
                                 "id int, d date, price_symbol string, ticker_yf string")
    first = series(spark, [(day(n), "A", 10.0 + n, None) for n in tier1] or [(day(99), "Z", 1.0, None)])
    second = spark.createDataFrame([(day(n), "T", 20.0 + n) for n in tier2] or [(day(99), "Z", 1.0)],
                                   "date date, ticker string, price double")
    r = asof.two_tier_close(rows, first, second, "d", "x", strictly_after=after).first()
    return r["x_price"], r["x_price_source"]


def test_published_price_wins_inside_its_week(spark):
    assert lookups(spark, [6], [0]) == (16.0, "platts")
    assert lookups(spark, [7], [0]) == (20.0, "yfinance")
    assert lookups(spark, [], [4]) == (24.0, "yfinance")
    assert lookups(spark, [], [5]) == (None, None)


def test_next_close_is_strictly_later(spark):
    assert lookups(spark, [0], [0], after=True) == (None, None)
    assert lookups(spark, [0, 7], [1], after=True) == (17.0, "platts")
    assert lookups(spark, [8], [7], after=True) == (27.0, "yfinance")


def test_fallback_symbol_looks_at_the_row_and_not_at_its_value(spark):
    rows = [(day(n), "Dubai", 1.0, 2.0) for n in range(6)]
    rows += [(day(0), "Brent", 1.0, 0.5), (day(1), "Brent", 1.0, None)]
    articles = spark.createDataFrame(
        [("a", "brent news", "", "s", day(0), "u", None), ("b", "brent news", "", "s", day(1), "u", None),
         ("c", "brent news", "", "s", day(2), "u", None), ("d", "x", "", "s", day(0), "u", "Bunkerwire"),
         ("e", "x", "", "s", None, "u", None)],
        "id string, headline string, body_text string, source string, published_at date, url string, report_name string")
    got = {r["id"]: (r["price_symbol"], r["label"]) for r in labels.label_articles(articles, series(spark, rows)).collect()}
    assert got == {"a": ("Brent", "LOW"), "c": ("Dubai", "MEDIUM")}


def test_momentum_needs_six_rows(spark):
    rows = [(day(n), "A", 100.0 + n, None) for n in range(7)] + [(day(n), "B", 1.0 + n, None) for n in range(5)]
    got = {r["symbol"]: (r["mom_5d"], r["mom_10d"]) for r in prices.latest_momentum(series(spark, rows)).collect()}
    assert got["A"] == (pytest.approx(5 / 101 * 100), pytest.approx(6.0)) and got["B"] == (0.0, 0.0)
