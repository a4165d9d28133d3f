"""Registered queries: the jobs of the desk, run over a desk of their own, and the tables they leave."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsignal import schemas
from newsignal.config import with_commodity_config
from newsignal.operators import trades
from newsignal.plans import jobs, ledger, trading
from newsignal.session import shared_dir
from newsignal.sources import adapters

TODAY = "1995-03-01"
RICH_DAY = "1995-01-06"  # a day with a feed, so that the daily job goes on to its end


def _desk(spark):
    return jobs.Desk(spark, f"{shared_dir(spark)}/newsignal/desk-{uuid.uuid4().hex}")


def _with_prices(spark, folder):
    desk = _desk(spark)
    desk.upsert("prices", adapters.prices(spark, folder), ["date", "symbol"], "symbol")
    return desk


def _labelled_desk(spark, folder):
    desk = _with_prices(spark, folder)
    jobs.ingest_articles(desk, adapters.articles(spark, folder))
    jobs.label_job(desk)
    return desk


def job_prices(spark, folder):
    """Price table after reports were ingested and the price job ran, twice."""
    desk = _desk(spark)
    jobs.ingest_articles(desk, adapters.reports(spark, folder))
    for _ in range(2):
        jobs.price_job(desk)
    return desk.read("prices").select("date", "symbol", "price", F.round("pct_change_24h", 6).alias("pct_change_24h"))


def job_labels(spark, folder):
    """Labelled articles after ingestion and the label job."""
    return _labelled_desk(spark, folder).read("labelled_articles").select("id", "aligned_date", "price_change", "label", "price_symbol")


def job_entities(spark, folder):
    """Entities of the labelled articles; a second run adds nothing."""
    desk = _labelled_desk(spark, folder)
    jobs.entity_job(desk, now="2001-08-01")
    if jobs.entity_job(desk, now="2001-08-02"):
        raise AssertionError("a repeated run has added entities")
    return desk.read("entities").select("article_id", "event_type", "region", "supply_impact", "impact_score")


def job_catch_up(spark, folder):
    """Articles after a catch-up: a first batch with blank and short bodies, and one with everything."""
    desk = _with_prices(spark, folder)
    everything = adapters.articles(spark, folder)
    part = F.col("id").cast("bigint") % 3
    first = everything.filter(part < 2).withColumn("body_text", F.when(part == 0, " ").otherwise(F.substring("body_text", 1, 50)))
    filled = jobs.catch_up_job(desk, [first, everything])
    return desk.read("articles").select("id", F.length("body_text").alias("body_chars"), F.lit(filled).cast("bigint").alias("n_filled"))


def _stored(spark, folder):
    """A few stored predictions, so that some days have theirs already."""
    return adapters.predictions(spark, folder).filter("trade_status = 'TRADE' and id % 11 = 0")


def job_signals(spark, folder):
    """Predictions that the signal job adds for days with enough articles and no trade."""
    desk = _with_prices(spark, folder)
    jobs.ingest_articles(desk, adapters.feed(spark, folder))
    known = _stored(spark, folder)
    batch = schemas.conform(known, schemas.PREDICTIONS).withColumn(jobs.MONTH, trades.month_of())
    desk.upsert("predictions", batch, ["prediction_date", "commodity", jobs.MONTH], jobs.MONTH)
    jobs.signal_job(desk, adapters.scored_articles(spark, folder), adapters.market_prices(spark, folder), "1995-01-05", "1995-02-20",
                    adapters.DESK_KEYWORDS)
    added = desk.read("predictions").join(known.select("prediction_date", "commodity"), ["prediction_date", "commodity"], "left_anti")
    return added.select("prediction_date", "commodity", "ticker", "signal", "direction", F.round("confidence", 6).alias("confidence"),
                        "expected_move", "entry_price", "entry_price_source", "trade_status", "trade_number", "event_type", "cut_loss_price")


def job_settlement(spark, folder):
    """Stored predictions after the settlement job."""
    desk = _with_prices(spark, folder)
    logged = with_commodity_config(trading.open_predictions(spark, folder), "ticker_yf")
    batch = schemas.conform(logged, schemas.PREDICTIONS).select(*schemas.PREDICTIONS.fieldNames())
    desk.upsert("predictions", batch.withColumn(jobs.MONTH, trades.month_of()), ["prediction_date", "commodity", jobs.MONTH], jobs.MONTH)
    jobs.settlement_job(desk, adapters.market_prices(spark, folder), trading.TODAY)
    return desk.read("predictions").select("id", "entry_price", "entry_price_source", "exit_price", "exit_price_source", "cut_loss_price",
                                           "actual_move", "outcome", "data_quality")


def job_daily(spark, folder):
    """Status of the feed and size of the tables after the daily job."""
    desk = _with_prices(spark, folder)
    status = jobs.daily_job(desk, adapters.feed(spark, folder), adapters.market_prices(spark, folder), TODAY)
    sizes = [desk.read(name).agg(F.count(F.lit(1))).scalar().alias(f"n_{name}") for name in ("articles", "labelled_articles", "entities")]
    return spark.range(1).select(F.lit(status).alias("status"), *sizes)


def job_resumed(spark, folder):
    """The daily job, ended after its labels and repeated under its name: steps of the ledger and size of the tables."""
    desk = _with_prices(spark, folder)
    feed, market = adapters.feed(spark, folder), adapters.market_prices(spark, folder)
    jobs.daily_job(desk, feed, market, RICH_DAY, run="day", until="label")
    status = jobs.daily_job(desk, feed, market, RICH_DAY, run="day")
    sizes = [desk.read(name).agg(F.count(F.lit(1))).scalar().alias(f"n_{name}") for name in ("articles", "labelled_articles", "entities")]
    runs = spark.read.schema(ledger.SCHEMA).parquet(desk.path("runs"))
    return runs.groupBy("step").agg(F.count(F.lit(1)).alias("n_finished")).select("step", "n_finished", F.lit(status).alias("status"), *sizes)


QUERIES = {f.__name__: f for f in [job_prices, job_labels, job_entities, job_catch_up, job_signals, job_settlement, job_daily, job_resumed]}
