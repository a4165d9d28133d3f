"""Articles to impact labels: route to a symbol, align to a trading day, look up the move, label it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.functions import rules
from newsignal.operators.prices import fixed_label, rolling_label, with_thresholds


def drop_noise_reports(articles: DataFrame, names: Sequence[str] = fv.LABEL_NOISE_REPORTS) -> DataFrame:
    """Drop routine price reports by name; an article without a report name stays."""
    return articles.filter(~F.coalesce(F.col("report_name"), F.lit("")).isin(list(names)))


def move_calendar(prices: DataFrame, symbols: Sequence[str], fixed_thresholds: bool = False,
                  max_gap: int = fv.MAX_ALIGN_GAP_DAYS) -> DataFrame:
    """(probe_date, aligned_date, moves): all that labelling needs to know about a publication day.

    ``moves`` maps each of ``symbols`` to its change and thresholds on the aligned day: the next date on which
    any symbol traded, within the gap (the exact day with fewer than ``MIN_TRADING_DATES`` dates).
    The table is derived from the prices in one pass. It has at most one row per calendar day and one entry
    per symbol that a rule can name, so it may be broadcast: articles are never shuffled.
    """
    ever_quoted = F.count("pct_change_24h").over(Window.partitionBy("symbol")) > 0
    usable = prices.withColumn("_quoted", ever_quoted).filter("_quoted").drop("_quoted")
    if fixed_thresholds:
        priced = usable.withColumns({"thresh_low": F.lit(fv.MEDIUM_PCT_FIXED),
                                     "thresh_high": F.lit(fv.HIGH_PCT_FIXED)})
    else:
        priced = with_thresholds(usable)
    named = F.when(F.col("symbol").isin(list(symbols)), F.struct(
        "symbol", F.struct("pct_change_24h", "thresh_low", "thresh_high")))
    moves = priced.groupBy("date").agg(F.map_from_entries(F.collect_list(named)).alias("moves"))
    n_dates = F.count(F.lit(1)).over(Window.partitionBy())  # one row per trading date
    reach = F.when(n_dates >= fv.MIN_TRADING_DATES, max_gap).otherwise(0)
    unfolded = moves.withColumn("_reach", reach).select(
        "date", "moves", F.explode(F.sequence(F.lit(0), F.col("_reach"))).alias("_gap"))
    return unfolded.groupBy(F.expr("date_sub(date, _gap)").alias("probe_date")).agg(
        F.min("date").alias("aligned_date"), F.min_by("moves", "date").alias("moves"))


def label_articles(articles: DataFrame, prices: DataFrame, routing: rules.Rules = fv.ROUTING_RULES,
                   default_symbol: str = fv.DEFAULT_SYMBOL,
                   noise: Sequence[str] = fv.LABEL_NOISE_REPORTS,
                   fixed_thresholds: bool = False, route: bool = True) -> DataFrame:
    """Label every article HIGH / MEDIUM / LOW by the move on the next trading day.

    A routed symbol without a row on that day falls back to the default symbol. A present row without
    a change is not replaced: such an article gets no label.
    """
    symbol = rules.first_match(F.col("_text"), routing, default_symbol) if route else F.lit(default_symbol)
    dated = (drop_noise_reports(articles, noise)
             .withColumn("probe_date", F.to_date("published_at"))
             .filter(F.col("probe_date").isNotNull())
             .withColumn("_text", rules.routing_text(F.col("headline"), F.col("body_text")))
             .withColumn("_routed", symbol).drop("_text"))
    symbols = {default_symbol, *(name for name, _ in routing)} if route else {default_symbol}
    aligned = dated.join(F.broadcast(move_calendar(prices, sorted(symbols), fixed_thresholds)), "probe_date")
    chosen = F.when(F.map_contains_key("moves", F.col("_routed")), F.col("_routed")) \
        .otherwise(default_symbol)
    priced = aligned.withColumn("price_symbol", chosen).withColumn(
        "_move", F.element_at("moves", F.col("price_symbol"))).filter("_move.pct_change_24h is not null")
    pct = F.col("_move.pct_change_24h")
    label = fixed_label(pct) if fixed_thresholds else \
        rolling_label(pct, F.col("_move.thresh_low"), F.col("_move.thresh_high"))
    return priced.select("id", "headline", "body_text", "source", "published_at", "url", "aligned_date",
                         F.round(pct, 4).alias("price_change"), label.alias("label"), "price_symbol")


def label_distribution(labelled: DataFrame) -> DataFrame:
    """Count and share of every label. The total is a window over one row per label."""
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("label", "n", F.round(F.col("n") / total * 100, 1).alias("share_pct"))


def label_crosstab(labelled: DataFrame, labels: Sequence[str] = ("HIGH", "LOW", "MEDIUM")) -> DataFrame:
    """Symbols by labels, 0 where a pair does not occur."""
    return labelled.groupBy("price_symbol").pivot("label", list(labels)).agg(F.count(F.lit(1))) \
        .fillna(0)


def direction_label(price_change, band: float = fv.EVALUATION_MOVE_PCT):
    return F.when(price_change > band, "rise").when(price_change < -band, "fall").otherwise("flat")
