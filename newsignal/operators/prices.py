"""Daily price series: one price per day, changes, rolling thresholds, momentum and features.

A series has one row per symbol and calendar day, so a window over a symbol is bounded by the number
of days on the calendar, whatever the size of the text the prices came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.functions.report_rows import report_prices
from newsignal.functions.text import is_blank
from newsignal.operators.keyed import one_per_key


def by_symbol():
    return Window.partitionBy("symbol").orderBy("date")


def price_rows(reports: DataFrame) -> DataFrame:
    """Price rows of all report texts (id, published_at, body_text); empty bodies are skipped."""
    rows = reports.filter(~is_blank(F.col("body_text")) & F.col("published_at").isNotNull()).select(
        "id", "published_at", F.explode_outer(report_prices(F.col("body_text"))).alias("row")) \
        .filter("row is not null")  # outer: no inferred filter that would parse every report twice
    return rows.select("id", "published_at", F.to_date("published_at").alias("date"), "row.*")


def latest_per_day(rows: DataFrame) -> DataFrame:
    """One price per symbol and day: the latest report, the larger id on a tie."""
    return one_per_key(rows, ["symbol", "date"],
                       [F.col("published_at").desc(), F.col("id").desc()])


def fill_change(prices: DataFrame, shift: int = -1) -> DataFrame:
    """Fill a missing percent change from consecutive prices.

    ``shift=-1`` takes the change of the *next* day, as the published labels do (a look-ahead);
    ``shift=0`` takes the day's own change.
    """
    if shift == -1:
        computed = F.try_divide(F.lead("price").over(by_symbol()), F.col("price")) - 1
    else:
        computed = F.try_divide(F.col("price"), F.lag("price").over(by_symbol())) - 1
    return prices.withColumn("pct_change_24h", F.coalesce("pct_change_24h", computed * 100))


def capped_change(pct: Column) -> Column:
    """Absolute change, capped against outliers; NULL stays NULL (``least`` alone would skip it)."""
    return F.when(pct.isNotNull(), F.least(F.abs(pct), F.lit(fv.OUTLIER_CAP_PCT)))


def with_thresholds(prices: DataFrame, days: int = fv.ROLLING_WINDOW_DAYS) -> DataFrame:
    """Rolling percentile thresholds of the absolute change, today included, per symbol."""
    frame = (Window.partitionBy("symbol").orderBy(F.col("_day")).rangeBetween(-days, 0))
    capped = capped_change(F.col("pct_change_24h"))
    with_cap = prices.withColumn("_day", F.unix_date("date")).withColumn("_abs", capped)
    enough = F.count("_abs").over(frame) >= fv.MIN_ROLLING_OBS
    low = F.greatest(F.percentile("_abs", F.lit(fv.LOW_QUANTILE)).over(frame),
                     F.lit(fv.MIN_THRESHOLD_STEP))
    high = F.percentile("_abs", F.lit(fv.HIGH_QUANTILE)).over(frame)
    return (with_cap.withColumns({"_enough": enough, "_low": low, "_high": high})
            .withColumn("thresh_low", F.when(F.col("_enough"), F.col("_low"))
                        .otherwise(fv.MEDIUM_PCT_FIXED))
            .withColumn("thresh_high", F.when(
                F.col("_enough"), F.greatest(F.col("_high"), F.col("_low") + fv.MIN_THRESHOLD_STEP))
                .otherwise(fv.HIGH_PCT_FIXED))
            .drop("_day", "_abs", "_enough", "_low", "_high"))


def rolling_label(pct: Column, low: Column, high: Column) -> Column:
    size = capped_change(pct)
    return F.when(size >= high, "HIGH").when(size >= low, "MEDIUM").when(size < low, "LOW")


def fixed_label(pct: Column) -> Column:
    return rolling_label(pct, F.lit(fv.MEDIUM_PCT_FIXED), F.lit(fv.HIGH_PCT_FIXED))


def day_flags(date: Column) -> dict[str, Column]:
    names = fv.NUMERIC_FEATURES[2:7]
    return {name: (F.weekday(date) == day).cast("double") for day, name in enumerate(names)}


def momentum(prices: DataFrame, rows: tuple[int, int] = (5, 10)) -> DataFrame:
    """Percent change over 5 and 10 rows back, 0 where there is no such row."""
    out = {name: F.coalesce((F.try_divide(F.col("price"), F.lag("price", n).over(by_symbol())) - 1) * 100,
                            F.lit(0.0))
           for name, n in zip(("mom_5d", "mom_10d"), rows)}
    return prices.withColumns(out)


def latest_momentum(prices: DataFrame) -> DataFrame:
    """Momentum from the newest 11 prices per symbol; 0 with fewer than 6 of them."""
    newest = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    ranked = prices.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= 11)
    picked = ranked.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("date", F.col("date")).alias("as_of"),
        F.max(F.when(F.col("_rank") == 1, F.col("price"))).alias("_now"),
        F.max(F.when(F.col("_rank") == 6, F.col("price"))).alias("_five"),
        F.max_by("price", "_rank").alias("_oldest"))

    def change(base: str) -> Column:
        return F.when(F.col("n") >= 6, F.coalesce(
            F.try_divide(F.col("_now") - F.col(base), F.col(base)) * 100, F.lit(0.0))).otherwise(0.0)

    return picked.select("symbol", "as_of", change("_five").alias("mom_5d"),
                         change("_oldest").alias("mom_10d"))


def articles_per_day(articles: DataFrame) -> DataFrame:
    return articles.groupBy(F.to_date("published_at").alias("date")).agg(
        F.count(F.lit(1)).alias("article_count"))


def daily_features(prices: DataFrame, articles: DataFrame, symbol: str = fv.DEFAULT_SYMBOL) -> DataFrame:
    """The eight numeric features per trading day of one symbol's series."""
    series = momentum(prices.filter(F.col("symbol") == symbol))
    counted = series.join(articles_per_day(articles), "date", "left")
    return counted.withColumns(day_flags(F.col("date"))).select(
        "date", *fv.NUMERIC_FEATURES[:7],
        F.coalesce(F.col("article_count").cast("double"), F.lit(0.0)).alias("article_count"))


def add_numeric_features(labelled: DataFrame, features: DataFrame) -> DataFrame:
    """Left join of the daily features on the aligned date; missing values are 0."""
    joined = labelled.join(features.withColumnRenamed("date", "aligned_date"), "aligned_date", "left")
    return joined.fillna(0.0, subset=fv.NUMERIC_FEATURES)


def symbol_summary(prices: DataFrame) -> DataFrame:
    return prices.filter(~is_blank(F.col("symbol"))).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"))


def price_series(predictions: DataFrame, since, commodity: str | None = None) -> DataFrame:
    """Entry and exit price of every prediction from a day on."""
    chosen = predictions.filter(F.col("prediction_date") >= F.lit(since).cast("date"))
    if commodity:
        chosen = chosen.filter(F.col("commodity") == commodity)
    return chosen.select("id", "prediction_date", "commodity", "signal", "direction", "entry_price",
                         "exit_price", "actual_move", "expected_move")
