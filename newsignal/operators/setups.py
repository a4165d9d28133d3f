"""Trade setups: entry zone, target, stop, reward to risk, win rate and expected value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.config import lookup, with_commodity_config
from newsignal.functions import trading
from newsignal.functions.numbers import half_up
from newsignal.operators.asof import two_tier_close


def win_rates(predictions: DataFrame, min_rows: int = 5) -> DataFrame:
    """Share of correct outcomes per commodity, signal and direction; the default below 5 rows."""
    decided = predictions.filter(F.col("outcome").isin("correct", "incorrect")).groupBy(
        "commodity", "signal", trading.direction(F.col("direction")).alias("direction")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "correct").alias("n_correct"))
    default = lookup(fv.DEFAULT_WIN_RATES, F.col("signal"), fv.FALLBACK_WIN_RATE)
    rate = F.when(F.col("n") >= min_rows, F.round(F.col("n_correct") / F.col("n"), 3)).otherwise(default)
    return decided.withColumn("win_rate", rate)


def recent_volatility(predictions: DataFrame, last: int = 10) -> DataFrame:
    """Entry-zone half width per commodity from the newest resolved moves."""
    newest = Window.partitionBy("commodity").orderBy(F.col("prediction_date").desc(), F.col("id").desc())
    moves = (predictions.filter("actual_move is not null")
             .select("commodity", "prediction_date", "id", "actual_move",
                     F.row_number().over(newest).alias("_k")).filter(F.col("_k") <= last))
    width = F.avg(F.abs("actual_move")) / 100 * 0.3
    return moves.groupBy("commodity").agg(
        F.least(F.greatest(width, F.lit(0.001)), F.lit(0.01)).alias("zone_pct"))


def _target(signal: Column, part: int) -> Column:
    return lookup({k: v[part] for k, v in fv.SETUP_TARGETS.items()}, signal,
                  fv.SETUP_TARGETS["LOW"][part])


def rating(confidence: Column, ratio: Column) -> Column:
    return (F.when((confidence >= 0.80) & (ratio >= 2.0), "strong")
            .when((confidence >= 0.65) & (ratio >= 1.5), "moderate")
            .when(confidence >= fv.SETUP_MIN_CONFIDENCE, "cautious").otherwise("skip"))


def rationale(side: Column, percent: Column, ratio: Column, win_rate: Column, rated: Column) -> Column:
    pct = F.round(percent, 0).cast("int").cast("string")
    head = F.concat(F.lit("HIGH impact — "), side, F.lit(" signal at "), pct, F.lit("% confidence. R:R "),
                    F.round(ratio, 1).cast("decimal(12,1)").cast("string"), F.lit(":1"))
    history = F.concat(F.lit(", "), F.floor(win_rate * 100).cast("string"),
                       F.lit("% historical win rate. "))
    return (F.when(rated == "strong", F.concat(head, history, F.lit("Strong fundamental setup.")))
            .when(rated == "moderate", F.concat(head, history, F.lit("Acceptable setup.")))
            .when(rated == "cautious", F.concat(head, F.lit(". Proceed with reduced position size.")))
            .otherwise(F.concat(F.lit("Confidence too low ("), pct,
                                F.lit("%). Wait for stronger fundamental signal."))))


def build_setups(signals: DataFrame, history: DataFrame, lot: int = fv.LOT_SIZE,
                 stop_pct: float | None = None) -> DataFrame:
    """Setups for HIGH, directional, confident signals that have an entry price.

    ``signals``: id, prediction_date, commodity, signal, direction, scaled_conf, entry_price.
    """
    s = signals.filter("entry_price is not null").withColumn(
        "direction", trading.direction(F.col("direction"))).withColumn(
        "confidence", F.col("scaled_conf") / 100)
    s = s.filter((F.col("signal") == "HIGH") & (F.col("direction") != "neutral")
                 & (F.col("confidence") >= fv.SETUP_MIN_CONFIDENCE))
    s = s.join(recent_volatility(history), "commodity", "left").join(
        win_rates(history).select("commodity", "signal", "direction", "win_rate"),
        ["commodity", "signal", "direction"], "left")
    zone = F.coalesce("zone_pct", F.lit(fv.DEFAULT_VOLATILITY))
    entry, side = F.col("entry_price"), trading.sign(F.col("direction"))
    share = F.least((F.col("confidence") - fv.SETUP_MIN_CONFIDENCE) / (1 - fv.SETUP_MIN_CONFIDENCE),
                    F.lit(1.0))
    low, high = _target(F.col("signal"), 0), _target(F.col("signal"), 1)
    stop_share = F.lit(stop_pct / 100) if stop_pct else lookup(fv.SETUP_STOPS, F.col("signal"), 1.0) / 100
    s = s.withColumns({
        "trade_direction": F.initcap("direction"), "entry_low": half_up(entry * (1 - zone), 4),
        "entry_high": half_up(entry * (1 + zone), 4), "_move": low + (high - low) * share,
        "stop_loss": half_up(entry * (1 - side * stop_share), 4),
        "win_rate": F.coalesce("win_rate", lookup(fv.DEFAULT_WIN_RATES, F.col("signal"),
                                                  fv.FALLBACK_WIN_RATE))})
    s = s.withColumn("target_price", half_up(entry * (1 + side * F.col("_move") / 100), 4))
    s = s.withColumns({"risk_usd": half_up(F.abs(entry - F.col("stop_loss")) * lot, 2),
                       "reward_usd": half_up(F.abs(F.col("target_price") - entry) * lot, 2)})
    s = s.withColumn("risk_reward", F.when(F.col("risk_usd") > 0, F.round(
        F.col("reward_usd") / F.col("risk_usd"), 2)).otherwise(0.0))
    s = s.withColumns({
        "expected_value": half_up(F.col("win_rate") * F.col("reward_usd")
                                  - (1 - F.col("win_rate")) * F.col("risk_usd"), 2),
        "rating": rating(F.col("confidence"), F.col("risk_reward"))})
    return s.withColumns({
        "target_move_pct": F.round("_move", 2), "stop_loss_pct": F.round(stop_share * 100, 2),
        "is_best": (F.col("risk_reward") >= fv.SETUP_BEST_RATIO) & (F.col("expected_value") > 0),
        "rationale": rationale(F.col("trade_direction"), F.col("scaled_conf"), F.col("risk_reward"),
                               F.col("win_rate"), F.col("rating"))}).drop("_move", "zone_pct")


def build_all_setups(signals: DataFrame, prices: DataFrame, market: DataFrame, history: DataFrame) -> DataFrame:
    """Setups of signals without a price: the close of their day is looked up in both price sources, and signals for
    which neither has one are left out."""
    rows = with_commodity_config(signals.drop("entry_price", "entry_price_source"), "price_symbol", "ticker_yf")
    priced = two_tier_close(rows, prices, market, "prediction_date", "entry")
    return build_setups(priced.drop("entry_date", "entry_symbol"), history)


def rank_setups(setups: DataFrame, by: str = "expected_value", best_only: bool = False,
                limit: int | None = None) -> DataFrame:
    """Order by expected value, confidence or reward to risk."""
    column = {"expected_value": "expected_value", "confidence": "scaled_conf",
              "risk_reward": "risk_reward"}[by]
    chosen = setups.filter("is_best") if best_only else setups
    ordered = chosen.orderBy(F.col(column).desc(), "prediction_date", "commodity", "id")
    return ordered.limit(limit) if limit else ordered


def setup_summary(setups: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    zero = F.lit(0.0)
    return setups.agg(
        n.alias("total"), F.count_if("is_best").alias("best_count"),
        F.coalesce(F.round(F.avg("risk_reward"), 2), zero).alias("avg_rr"),
        F.coalesce(F.round(F.avg("expected_value"), 2), zero).alias("avg_ev"),
        F.coalesce(F.round(F.try_divide(F.count_if(F.col("scaled_conf") >= 70), n) * 100, 0), zero)
        .alias("high_conf_pct"),
        F.coalesce(F.round(F.avg("win_rate") * 100, 1), zero).alias("avg_win_rate"))


def historical_setups(predictions: DataFrame, today, days: int = 30) -> DataFrame:
    """Target, stop and reward to risk as they would have been, for the last days.

    Neutral rows are kept out: a setup needs a side.
    """
    since = F.date_sub(F.lit(today).cast("date"), days)
    side = trading.sign(trading.direction(F.col("direction")))
    rows = predictions.filter((F.col("prediction_date") >= since) & F.col("entry_price").isNotNull()
                              & (side != 0))
    entry = F.col("entry_price")
    stop_share = lookup(fv.SETUP_STOPS, F.col("signal"), 1.0) / 100
    rows = rows.withColumns({
        "target_price": half_up(entry * (1 + side * _target(F.col("signal"), 2) / 100), 4),
        "stop_loss": half_up(entry * (1 - side * stop_share), 4)})
    rows = rows.withColumns({"risk_usd": F.abs(entry - F.col("stop_loss")) * fv.LOT_SIZE,
                             "reward_usd": F.abs(F.col("target_price") - entry) * fv.LOT_SIZE})
    return rows.withColumns({
        "risk_reward": F.round(F.try_divide(F.col("reward_usd"), F.col("risk_usd")), 2),
        "confidence_pct": F.round(F.col("confidence") * 100, 1)})
