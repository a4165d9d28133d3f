"""Registered queries: price series, as-of lookups and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.config import with_commodity_config
from newsignal.operators import asof, labels, prices
from newsignal.operators import features as feat
from newsignal.sources import adapters


def _labelled(spark, folder):
    return labels.label_articles(adapters.articles(spark, folder), adapters.prices(spark, folder),
                                 adapters.DESK_ROUTING, "Dubai", adapters.DESK_NOISE)


def label_articles(spark, folder):
    """Flagship: documents routed, aligned to a trading day and labelled by the size of the move."""
    return _labelled(spark, folder).select(
        "id", "aligned_date", "price_change", "label", "price_symbol")


def label_articles_energy(spark, folder):
    """The same with the package's own energy keywords and noise list."""
    return labels.label_articles(adapters.articles(spark, folder), adapters.prices(spark, folder)) \
        .select("id", "aligned_date", "price_change", "label", "price_symbol")


def label_articles_fixed(spark, folder):
    """Fixed thresholds and no routing."""
    return labels.label_articles(
        adapters.articles(spark, folder), adapters.prices(spark, folder),
        fixed_thresholds=True, route=False).select("id", "aligned_date", "price_change", "label")


def label_distribution(spark, folder):
    return labels.label_distribution(_labelled(spark, folder))


def label_crosstab(spark, folder):
    return labels.label_crosstab(_labelled(spark, folder))


def rolling_thresholds(spark, folder):
    return prices.with_thresholds(adapters.prices(spark, folder)).select(
        "date", "symbol", F.round("thresh_low", 6).alias("thresh_low"),
        F.round("thresh_high", 6).alias("thresh_high"),
        prices.rolling_label(F.col("pct_change_24h"), F.col("thresh_low"), F.col("thresh_high"))
        .alias("rolling_label"),
        prices.fixed_label(F.col("pct_change_24h")).alias("fixed_label"))


def trading_day_alignment(spark, folder):
    days = adapters.articles(spark, folder).select("id", F.col("published_at").alias("probe_date"))
    calendar = asof.trading_calendar(adapters.prices(spark, folder))
    return days.join(calendar, "probe_date", "left").select("id", "probe_date", "aligned_date")


def _dated_commodities(spark, folder):
    return with_commodity_config(
        adapters.predictions(spark, folder).select("id", "commodity", "prediction_date"),
        "price_symbol", "ticker_yf")


def closing_price(spark, folder):
    out = asof.two_tier_close(_dated_commodities(spark, folder), adapters.prices(spark, folder),
                              adapters.market_prices(spark, folder), "prediction_date", "entry")
    return out.select("id", "entry_price", "entry_price_source", "entry_date", "entry_symbol")


def next_close(spark, folder):
    out = asof.two_tier_close(_dated_commodities(spark, folder), adapters.prices(spark, folder),
                              adapters.market_prices(spark, folder), "prediction_date", "exit",
                              strictly_after=True)
    return out.select("id", "exit_price", "exit_price_source", "exit_date", "exit_symbol")


def fill_missing_change(spark, folder):
    """Every third change is taken away and filled from the next price."""
    holes = adapters.prices(spark, folder).withColumn(
        "pct_change_24h", F.when(F.day("date") % 3 != 0, F.col("pct_change_24h")))
    own = prices.fill_change(holes, shift=0).select(
        "date", "symbol", F.round("pct_change_24h", 6).alias("own_day_pct"))
    return prices.fill_change(holes).select(
        "date", "symbol", F.round("pct_change_24h", 6).alias("next_day_pct")).join(own, ["date", "symbol"])


def momentum(spark, folder):
    return prices.momentum(adapters.prices(spark, folder)).select(
        "date", "symbol", F.round("mom_5d", 6).alias("mom_5d"), F.round("mom_10d", 6).alias("mom_10d"))


def latest_momentum(spark, folder):
    return prices.latest_momentum(adapters.prices(spark, folder)).select(
        "symbol", "as_of", F.round("mom_5d", 6).alias("mom_5d"), F.round("mom_10d", 6).alias("mom_10d"))


def daily_features(spark, folder):
    rows = prices.daily_features(adapters.prices(spark, folder), adapters.articles(spark, folder))
    return rows.select("date", F.round("mom_5d", 6).alias("mom_5d"), F.round("mom_10d", 6).alias("mom_10d"),
                       *fv.NUMERIC_FEATURES[2:])


def article_features(spark, folder):
    """Numeric features merged into labelled articles."""
    daily = prices.daily_features(adapters.prices(spark, folder), adapters.articles(spark, folder))
    merged = prices.add_numeric_features(
        _labelled(spark, folder).select("id", "aligned_date", "label"), daily)
    return merged.select("id", "aligned_date", "label", F.round("mom_5d", 6).alias("mom_5d"),
                         F.round("mom_10d", 6).alias("mom_10d"), *fv.NUMERIC_FEATURES[2:])


def articles_per_day(spark, folder):
    return prices.articles_per_day(adapters.feed(spark, folder))


def weekday_flags(spark, folder):
    days = adapters.prices(spark, folder).select("date").distinct()
    return days.withColumns(prices.day_flags(F.col("date")))


def symbol_summary(spark, folder):
    return prices.symbol_summary(adapters.prices(spark, folder))


def trading_dates(spark, folder):
    return adapters.prices(spark, folder).select("date").distinct()


def priced_symbols(spark, folder):
    return adapters.prices(spark, folder).where("pct_change_24h is not null").select("symbol").distinct()


def entry_exit_series(spark, folder):
    return prices.price_series(adapters.settled_predictions(spark, folder), "1998-01-01").select(
        "id", "prediction_date", "commodity", "signal", "entry_price", "exit_price")


def predicted_actual_pairs(spark, folder):
    return feat.predicted_actual(prices.price_series(
        adapters.settled_predictions(spark, folder), "1995-01-01"))


def identity_line(spark, folder):
    """Bounds of the predicted-against-actual chart."""
    return predicted_actual_pairs(spark, folder).agg(
        F.min(F.least("predicted_move", "actual_move")).alias("low"),
        F.max(F.greatest("predicted_move", "actual_move")).alias("high"))


def same_day_shared_price(spark, folder):
    from newsignal.operators import quality
    return quality.shared_prices(adapters.priced_predictions(spark, folder))


QUERIES = {f.__name__: f for f in [
    label_articles, label_articles_energy, label_articles_fixed, label_distribution, label_crosstab,
    rolling_thresholds, trading_day_alignment, closing_price, next_close, fill_missing_change, momentum,
    latest_momentum, daily_features, article_features, articles_per_day, weekday_flags, symbol_summary,
    trading_dates, priced_symbols, entry_exit_series, predicted_actual_pairs, identity_line,
    same_day_shared_price]}
