"""Ordered curves against pandas, with cells small enough for many of them in one day."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsignal.operators import curves, metrics

SCHEMA = "id bigint, prediction_date date, pnl double"


@pytest.fixture(params=[(18, 41), (2, 4)], ids=["usual cells", "small cells"])
def cells(request, monkeypatch):
    monkeypatch.setattr(curves, "CELL_BITS", request.param[0])
    monkeypatch.setattr(curves, "BLOCK_BITS", request.param[1])


def table(spark, hot=False):
    """Whole-number results, so sums are exact in any order; one day holds a third of the rows, ids jump and are negative too."""
    rng = np.random.default_rng(2)
    ids = np.concatenate([np.arange(300), rng.choice(np.arange(-2**40, 2**40, 977), 200, replace=False)])
    rows = [(int(i), None if n % 50 == 49 else dt.date(2020, 1, 1) + dt.timedelta(days=0 if n % 3 == 0 else int(i) % 40),
             None if n % 17 == 0 else float(rng.integers(-50, 50))) for n, i in enumerate(ids)]
    pdf = pd.DataFrame(rows, columns=["id", "prediction_date", "pnl"])
    pdf["day"] = pd.to_datetime(pdf["prediction_date"]).fillna(pd.Timestamp(1900, 1, 1))
    return spark.createDataFrame(rows, SCHEMA).repartition(5), pdf.sort_values(["day", "id"]).reset_index(drop=True)


def test_equity_peak_and_drawdown(spark, cells):
    df, want = table(spark)
    got = metrics.equity_curve(df, "pnl").toPandas().set_index("id").loc[want["id"]].reset_index()
    equity = want["pnl"].fillna(0).cumsum()
    assert np.array_equal(got["equity"], equity) and np.array_equal(got["peak"], equity.cummax())
    assert np.array_equal(got["drawdown"], equity - equity.cummax())
    totals = curves.equity_totals(df, "pnl", {"n": F.count(F.lit(1)), "s": F.sum("pnl")}).first()
    assert tuple(totals) == ((equity - equity.cummax()).min(), len(want), want["pnl"].sum())


@pytest.mark.parametrize("size,least", [(10, 3), (2, 1), (7, 1), (40, 20)])
def test_rolling_means(spark, cells, size, least):
    df, want = table(spark)
    got = curves.rolling_mean(df, "pnl", "m", size, least).toPandas().set_index("id").loc[want["id"]]
    expected = want["pnl"].rolling(size, min_periods=least).mean()
    assert np.allclose(got["m"].astype(float), expected, equal_nan=True)


def test_empty_tables_give_empty_curves(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert metrics.equity_curve(none, "pnl").count() == 0
    assert curves.rolling_mean(none, "pnl", "m", 3).count() == 0
    assert metrics.max_drawdown(none, "pnl").first()["max_drawdown_usd"] is None
    assert tuple(curves.exact_percentile(none, "pnl", 0.05).first()) == (0, None)


@pytest.mark.parametrize("quantile", [0.0, 0.05, 0.5, 0.937, 1.0])
@pytest.mark.parametrize("kind", ["ties", "wide", "narrow", "single"])
def test_percentile_matches_numpy(spark, kind, quantile):
    rng = np.random.default_rng(5)
    values = {"ties": rng.integers(-3, 3, 400).astype(float), "wide": rng.normal(size=401) * 10.0 ** rng.integers(-200, 200, 401),
              "narrow": 1000 + rng.normal(size=300) * 1e-9, "single": np.array([-2.5])}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "pnl double")
    got = curves.exact_percentile(df, "pnl", quantile).first()
    assert got["n"] == len(values) and got["percentile"] == pytest.approx(np.percentile(values, quantile * 100), rel=1e-12)


def test_curves_need_no_ranges_and_no_written_runs(spark, tmp_path):
    """Scans are counted in the plan that ran, where equal exchanges are used again."""
    path = str(tmp_path / "t")
    table(spark)[0].write.parquet(path)
    stored = spark.read.parquet(path)
    for frame, most in [(metrics.equity_curve(stored, "pnl"), 2), (metrics.max_drawdown(stored, "pnl"), 1),
                        (curves.rolling_mean(stored, "pnl", "m", 10), 2)]:
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert "rangepartitioning" not in final and 1 <= final.count("FileScan parquet") <= most
