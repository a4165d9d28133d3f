"""Runs that end early go on where they ended."""

import datetime as dt

import pytest

from newsignal.plans import jobs, ledger

ARTICLE = "id string, title string, headline string, body_text string, published_at timestamp, report_name string"
TABLES = ("articles", "labelled_articles", "entities")


def feed(spark, n=25):
    day = dt.datetime(2024, 1, 5)
    return spark.createDataFrame([(f"a{i}", "T", f"Brent rises {i}", "Opec cuts crude oil output", day, "News") for i in range(n)], ARTICLE)


def prepared(spark, folder):
    desk = jobs.Desk(spark, str(folder))
    rows = [(dt.date(2024, 1, d), "Dubai", 80.0 + d, 1.0) for d in range(2, 12)]
    desk.upsert("prices", spark.createDataFrame(rows, "date date, symbol string, price double, pct_change_24h double"), ["date", "symbol"], "symbol")
    return desk


def content(desk):
    return {name: sorted(repr(r) for r in desk.read(name).drop("extracted_at", "fetched_at").collect()) for name in TABLES}


def test_a_killed_job_goes_on_and_leaves_the_same_tables(spark, tmp_path, monkeypatch):
    market = spark.createDataFrame([(dt.date(2024, 1, 5), "BZ=F", 70.0)], "date date, ticker string, price double")
    whole, killed = prepared(spark, tmp_path / "whole"), prepared(spark, tmp_path / "killed")
    calls = []
    for name in ("ingest_articles", "label_job", "entity_job", "settlement_job"):
        plain = getattr(jobs, name)
        monkeypatch.setattr(jobs, name, lambda *a, _name=name, _plain=plain, **k: (calls.append(_name), _plain(*a, **k))[1])
    assert jobs.daily_job(whole, feed(spark), market, "2024-01-05") == "OK"
    counted = jobs.entity_job

    def dies_after_writing(*args):
        counted(*args)
        raise RuntimeError("executor lost")

    monkeypatch.setattr(jobs, "entity_job", dies_after_writing)
    with pytest.raises(RuntimeError):
        jobs.daily_job(killed, feed(spark), market, "2024-01-05", run="day")
    monkeypatch.setattr(jobs, "entity_job", counted)
    calls.clear()
    assert jobs.daily_job(killed, feed(spark).repartition(3), market, "2024-01-05", run="day") == "OK"
    assert calls == ["entity_job", "settlement_job"]
    assert content(killed) == content(whole) and len(content(whole)["entities"]) == 25
    calls.clear()
    assert jobs.daily_job(killed, feed(spark), market, "2024-01-05", run="day") == "OK" and calls == []
    assert jobs.daily_job(killed, feed(spark, 26), market, "2024-01-05", run="day") == "OK"  # another input
    assert len(calls) == 4 and killed.read("articles").count() == 26


def test_versions_depend_on_rows_repeats_and_parameters_only(spark):
    one = spark.createDataFrame([(1, "a"), (2, None)], "n int, `odd.name` string")
    version = ledger.input_version(one)
    assert version == ledger.input_version(one.orderBy("n", ascending=False).repartition(2))
    others = [ledger.input_version(x) for x in (one.union(one), one.limit(0), one.filter("n = 1"))] + [ledger.input_version(one, parameters=[1])]
    assert len({version, *others}) == 5
