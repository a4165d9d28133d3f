"""Trade rules, metrics and checks on hand-made rows."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsignal.functions import trading
from newsignal.operators import metrics, quality, setups, trades

D = dt.date


@pytest.mark.parametrize("entry,exit_,side,stop,expected", [
    (100.0, 98.5, "Bullish", 98.5, (-1500.0, -1.5, "loss")),
    (100.0, 98.0, "Bullish", 98.5, (-1500.0, -2.0, "cut-loss")),
    (100.0, 98.0, "Bullish", None, (-2000.0, -2.0, "cut-loss")),
    (100.0, 99.8, "Bullish", None, (-200.0, -0.2, "loss")),
    (100.0, 99.9, "Bullish", None, (-100.0, -0.1, "neutral")),
    (100.0, 98.0, "Bearish", 101.5, (2000.0, -2.0, "win")),
    (100.0, 103.0, "Bearish", 101.5, (-1500.0, 3.0, "cut-loss")),
    (100.0, None, "Bearish", None, (0.0, 0.0, "pending")),
    (100.0, 98.0, "Hold", None, (0.0, 0.0, "hold"))])
def test_trade_results(spark, entry, exit_, side, stop, expected):
    df = spark.createDataFrame([(entry, exit_, side, stop)], "e double, x double, s string, c double")
    r = df.select(trading.trade_result(F.col("e"), F.col("x"), F.col("s"), F.col("c")).alias("r")).first()["r"]
    assert tuple(r) == pytest.approx(expected) if expected[2] == "" else (
        r["pnl_usd"], round(r["return_pct"], 4), r["trade_outcome"]) == expected


@pytest.mark.parametrize("direction,move,exit_,stop,expected", [
    ("bullish", -1.5, 98.5, 98.5, "cut-loss"), ("neutral", 0.99, 100.0, None, "correct"),
    ("neutral", 1.0, 100.0, None, "incorrect"), ("bearish", -0.1, 99.9, 101.0, "correct"),
    ("bullish", 0.0, 100.0, 98.0, "incorrect")])
def test_outcomes(spark, direction, move, exit_, stop, expected):
    df = spark.createDataFrame([(direction, move, 100.0, stop, exit_)],
                               "d string, m double, e double, c double, x double")
    got = df.select(trading.outcome(F.col("d"), F.col("m"), F.col("e"), F.col("c"), F.col("x")).alias("o")).first()
    assert got["o"] == expected


def predictions(spark, n=12, **changes):
    base = dict(signal="HIGH", direction="rise", confidence=0.8, expected_move=">3%", event_type="sanctions")
    rows = [{**base, "id": i, "prediction_date": D(2024, 1, 1 + i), "commodity": "WTI (PCACG00)",
             **{k: (v(i) if callable(v) else v) for k, v in changes.items()}} for i in range(n)]
    return spark.createDataFrame(pd.DataFrame(rows)).withColumn("prediction_date", F.col("prediction_date").cast("date"))


def test_budget_numbers_eight_trades(spark):
    got = {r["id"]: r for r in trades.decide_trades(predictions(spark)).collect()}
    assert [got[i]["trade_number"] for i in range(9)] == [1, 2, 3, 4, 5, 6, 7, 8, None]
    assert got[7]["remaining_budget"] == 0 and got[8]["trade_status"] == "WATCH"
    taken = spark.createDataFrame([("2024-01", 6)], "month string, n_trades bigint")
    later = {r["id"]: r for r in trades.decide_trades(predictions(spark), taken).collect()}
    assert [later[i]["trade_number"] for i in range(3)] == [7, 8, None]


@pytest.mark.parametrize("changes,status", [
    ({"signal": "MEDIUM"}, "HOLD"), ({"confidence": 0.54}, "WATCH"), ({"expected_move": "<1%"}, "WATCH"),
    ({"event_type": "routine_report"}, "WATCH"), ({"confidence": 0.55}, "TRADE")])
def test_first_failing_rule_decides(spark, changes, status):
    assert trades.decide_trades(predictions(spark, 1, **changes)).first()["trade_status"] == status


def test_ratios_match_numpy(spark):
    rng = np.random.default_rng(1)
    pnl = rng.normal(50, 400, 40).round(2)
    df = spark.createDataFrame([(float(p), 80.0 + i) for i, p in enumerate(pnl)], "pnl double, entry double")
    r = metrics.risk_ratios(df, F.col("pnl"), F.col("entry")).first()
    excess = pnl / (np.mean([80.0 + i for i in range(40)]) * 1000) * 100 - 0.05 / 252
    down = excess[excess < 0]
    assert r["sharpe_ratio"] == pytest.approx(excess.mean() / excess.std(ddof=1) * 252 ** 0.5, abs=0.006)
    assert r["sortino_ratio"] == pytest.approx(excess.mean() / down.std(ddof=1) * 252 ** 0.5, abs=0.006)
    few = metrics.risk_ratios(df.limit(4), F.col("pnl"), F.col("entry")).first()
    assert few["sharpe_ratio"] is None


def test_peak_starts_at_the_first_equity(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 1), -5.0), (2, D(2024, 1, 2), 0.0)],
                               "id bigint, prediction_date date, pnl double")
    assert metrics.max_drawdown(df, "pnl").first()["max_drawdown_usd"] == 0.0


def test_profit_factor_without_losses(spark):
    df = spark.createDataFrame([(10.0,)], "p double").agg(
        metrics.profit_factor(F.sum("p"), F.sum(F.lit(None).cast("double"))).alias("f"))
    assert math.isinf(df.first()["f"])


def test_win_rate_default_below_five_rows(spark):
    rows = [(c, "HIGH", "rise", "correct") for c in "a" * 4 + "b" * 5]
    df = spark.createDataFrame(rows, "commodity string, signal string, direction string, outcome string")
    got = {r["commodity"]: r["win_rate"] for r in setups.win_rates(df).collect()}
    assert got == {"a": 0.55, "b": 1.0}


def test_evaluation_band_is_exclusive(spark):
    df = spark.createDataFrame(
        [(1, "rise", 100.0, 101.0, None), (2, "rise", 100.0, 101.1, None), (3, "fall", None, None, None)],
        "id int, direction string, entry_price double, exit_price double, actual_move double")
    got = {r["id"]: (r["actual_direction"], r["is_correct"], r["status"]) for r in metrics.evaluation_rows(df).collect()}
    assert got == {1: ("flat", False, "evaluated"), 2: ("rise", True, "evaluated"), 3: (None, None, "pending")}


def test_shared_prices_across_cells_and_a_crowded_day(spark):
    rows = [(i, "Brent", D(2024, 1, 1), 80.0) for i in range(300)]
    rows += [(1000 + i, "Dubai", D(2024, 1, 1), 80.00009 if i % 2 else 80.0002) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, commodity string, prediction_date date, entry_price double")
    got = quality.shared_prices(df).agg(F.count("id"), F.sum("n_matches")).first()
    assert tuple(got) == (300, 300 * 150)


def test_shares_of_no_rows_and_of_halves(spark):
    rows = [("evaluated", n < 23, "LOW", 0.5) for n in range(80)]  # no HIGH signal, no large move
    df = spark.createDataFrame(rows, "status string, is_correct boolean, signal string, return_pct double")
    got = metrics.accuracy_summary(df).first()
    assert (got["total_evaluated"], got["accuracy_pct"]) == (80, 28.8)  # 23 / 80 * 100 is 28.749999999999996
    assert math.isnan(got["high_precision_pct"]) and math.isnan(got["high_recall_pct"])
