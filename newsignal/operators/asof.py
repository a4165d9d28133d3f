"""Forward as-of lookups with a bounded gap.

The price side is small next to whatever is looked up: it has one row per symbol and calendar day.
So the gap is unfolded there, backwards, into a table "looked-up day -> first price at or after it",
and the large side needs one equality join and no explosion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal import fixed_values as fv


def forward_table(prices: DataFrame, key: str, max_gap: int, values: Sequence[str],
                  min_gap: int = 0, date: str = "date") -> DataFrame:
    """For every key and day d: the row with the smallest date in [d+min_gap, d+max_gap].

    Columns: key, ``probe_date``, ``found_date`` and the values. Per key and day at most
    ``max_gap - min_gap + 1`` candidates meet, and they are combined before the shuffle.
    """
    days = F.sequence(F.lit(min_gap), F.lit(max_gap))
    unfolded = prices.select(key, date, *values, F.explode(days).alias("_gap")).withColumn(
        "probe_date", F.date_sub(F.col(date), F.col("_gap")))
    first = F.min(F.struct(F.col(date), *[F.col(v) for v in values])).alias("_hit")
    return unfolded.groupBy(key, "probe_date").agg(first).select(
        key, "probe_date", F.col(f"_hit.{date}").alias("found_date"), *[f"_hit.{v}" for v in values])


def trading_calendar(prices: DataFrame, max_gap: int = fv.MAX_ALIGN_GAP_DAYS) -> DataFrame:
    """(probe_date, aligned_date): next date on which any symbol traded, within the gap.

    With fewer than ``MIN_TRADING_DATES`` trading dates only the exact day counts.
    """
    dates = prices.select("date").distinct()
    n_dates = prices.agg(F.count_distinct("date")).scalar()
    reach = F.when(n_dates >= fv.MIN_TRADING_DATES, max_gap).otherwise(0)
    return (dates.withColumn("_reach", reach)
            .select("date", F.explode(F.sequence(F.lit(0), F.col("_reach"))).alias("_gap"))
            .groupBy(F.expr("date_sub(date, _gap)").alias("probe_date"))
            .agg(F.min("date").alias("aligned_date")))


def two_tier_close(df: DataFrame, prices: DataFrame, market: DataFrame, date: str, prefix: str,
                   strictly_after: bool = False) -> DataFrame:
    """Attach the close of (price_symbol, ticker_yf) as of ``date``: published price, else market price.

    Columns added: ``{prefix}_price``, ``{prefix}_price_source``, ``{prefix}_date``, ``{prefix}_symbol``.
    A published price inside its window wins over any market price, also over an earlier one.
    """
    low = 1 if strictly_after else 0
    high1 = fv.NEXT_CLOSE_DAYS if strictly_after else fv.CLOSE_TIER1_DAYS - 1
    high2 = fv.NEXT_CLOSE_DAYS if strictly_after else fv.CLOSE_TIER2_DAYS - 1
    usable = (F.col("price") != 0)
    tier1 = forward_table(prices.filter(usable), "symbol", high1, ["price"], low).select(
        F.col("symbol").alias("price_symbol"), F.col("probe_date").alias(date),
        F.struct(F.round("price", 4).alias("price"), F.lit(fv.TIER1).alias("source"),
                 F.col("found_date").alias("date"), F.col("symbol").alias("symbol")).alias("_tier1"))
    tier2 = forward_table(market.filter(F.col("price") > 0), "ticker", high2, ["price"], low).select(
        F.col("ticker").alias("ticker_yf"), F.col("probe_date").alias(date),
        F.struct(F.round("price", 4).alias("price"), F.lit(fv.TIER2).alias("source"),
                 F.col("found_date").alias("date"), F.col("ticker").alias("symbol")).alias("_tier2"))
    hit = F.coalesce(F.col("_tier1"), F.col("_tier2"))
    return (df.join(tier1, ["price_symbol", date], "left").join(tier2, ["ticker_yf", date], "left")
            .withColumns({f"{prefix}_price": hit["price"], f"{prefix}_price_source": hit["source"],
                          f"{prefix}_date": hit["date"], f"{prefix}_symbol": hit["symbol"]})
            .drop("_tier1", "_tier2"))
