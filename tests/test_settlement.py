"""The incremental settlement: due months only, and equal to a full run."""

import datetime as dt

from pyspark.sql import functions as F

from newsignal import schemas
from newsignal.operators import trades
from newsignal.plans import jobs
from newsignal.sources import sinks

D = dt.date
MARKET = "date date, ticker string, price double"
PRICES = "date date, symbol string, price double, pct_change_24h double"


def logged(spark, *days, start=0):
    rows = [(start + n, day, c, t, "HIGH", "rise" if n % 2 else "fall", 0.5 + n / 100, "TRADE" if n % 3 else "HOLD")
            for n, (day, (c, t)) in enumerate((day, c) for day in days for c in [("Brent", "BZ=F"), ("Dubai", "BZ=F")])]
    df = spark.createDataFrame(rows, "id bigint, prediction_date date, commodity string, ticker_yf string, signal string, "
                                     "direction string, confidence double, trade_status string")
    return schemas.conform(df, schemas.PREDICTIONS).select(*schemas.PREDICTIONS.fieldNames()).withColumn(jobs.MONTH, trades.month_of())


def market(spark, *days):
    return spark.createDataFrame([(d, "BZ=F", 70.0 + d.toordinal() % 13) for d in days], MARKET)


def add(desk, batch):
    sinks.append_absent(batch, desk.path("predictions"), ["prediction_date", "commodity", jobs.MONTH], [F.col("id")], jobs.MONTH)


def content(desk):
    return sorted(map(repr, desk.read("predictions").select(*schemas.PREDICTIONS.fieldNames()).collect()))


def files(desk):
    return sorted(desk.spark.read.parquet(desk.path("predictions")).inputFiles())


def test_settlement_by_due_months_equals_full_runs(spark, tmp_path, monkeypatch):
    desks = [jobs.Desk(spark, str(tmp_path / name)) for name in ("due", "full")]
    months = []
    plain = trades.settle
    monkeypatch.setattr(trades, "settle", lambda rows, *rest: (months.append(
        sorted({r[0].month for r in rows.select("prediction_date").distinct().collect()})), plain(rows, *rest))[1])
    days = [D(2024, 1, 10), D(2024, 1, 30), D(2024, 2, 10), D(2024, 3, 4), D(2024, 3, 5)]
    seen = [D(2024, 1, d) for d in (10, 11, 12)]
    steps = [  # new predictions, new market days, day of the run, months that are looked at
        (days, seen, D(2024, 3, 5), [1, 2, 3]),
        ([], [], D(2024, 3, 5), [3]),  # the month of the day itself stays due
        ([], [D(2024, 2, 1)], D(2024, 3, 5), [1, 2, 3]),  # within reach of 30 January
        ([], [], D(2024, 3, 9), [3]),
        ([D(2024, 2, 20)], [D(2024, 3, 5), D(2024, 3, 6)], D(2024, 3, 9), [2, 3])]
    for n, (new, more, today, expected) in enumerate(steps):
        seen = seen + more
        for desk, full in zip(desks, (False, True)):
            if n == 0:
                desk.upsert("prices", spark.createDataFrame([(D(2024, 1, 11), "Dubai", 80.0, 1.0)], PRICES), ["date", "symbol"], "symbol")
            if new:
                add(desk, logged(spark, *new, start=100 * n))
            before = files(desk)
            months.clear()
            jobs.settlement_job(desk, market(spark, *seen), today, full=full)
            if not full:
                assert months == [expected]
                if n == 1:
                    assert files(desk) == before  # no new prices: nothing is rewritten
        assert content(desks[0]) == content(desks[1])
    settled = desks[0].read("predictions").filter("outcome is not null").select("prediction_date").distinct()
    # only these two days have an entry price and another price after it
    assert {row[0] for row in settled.collect()} == {D(2024, 1, 10), D(2024, 3, 5)}


def test_settlement_without_predictions_and_after_a_lost_mark(spark, tmp_path):
    desk = jobs.Desk(spark, str(tmp_path / "desk"))
    assert jobs.settlement_job(desk, market(spark, D(2024, 1, 10)), D(2024, 2, 1)).first()["total_predictions"] == 0
    add(desk, logged(spark, D(2024, 1, 10)))
    found = market(spark, D(2024, 1, 10), D(2024, 1, 11))
    jobs.settlement_job(desk, found, D(2024, 2, 1))
    before = content(desk)
    spark.range(0).select(F.lit(None).cast("date").alias("day")).write.mode("overwrite").parquet(desk.path("settlement_mark/day"))
    assert jobs._months_to_settle(desk, desk.read("predictions"), {}, D(2024, 2, 1), desk.path("settlement_mark")) is None
    jobs.settlement_job(desk, found, D(2024, 2, 1))
    assert content(desk) == before
