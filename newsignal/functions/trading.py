"""Trade rules on one prediction row, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.config import lookup
from newsignal.functions.numbers import half_up


def direction(value: Column) -> Column:
    """Any spelling of a direction to bullish, bearish or neutral."""
    name = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return (F.when(name.isin("rise", "bullish", "long", "buy"), "bullish")
            .when(name.isin("fall", "bearish", "short", "sell"), "bearish").otherwise("neutral"))


def sign(canonical: Column) -> Column:
    return F.when(canonical == "bullish", 1).when(canonical == "bearish", -1).otherwise(0)


def unit_confidence(value: Column) -> Column:
    """Confidence on the 0-1 scale, whichever scale it came in."""
    return F.when(value > 1.0, value / 100).otherwise(value)


def expected_move_pct(bucket: Column) -> Column:
    return lookup(fv.EXPECTED_MOVES, bucket, fv.EXPECTED_MOVES["<1%"])


def move_pct(entry: Column, exit_: Column) -> Column:
    return F.try_divide(exit_ - entry, entry) * 100


def trade_direction(signal: Column, canonical: Column, confidence: Column,
                    threshold: float = fv.TRADE_CONFIDENCE) -> Column:
    """Bullish or Bearish for a confident HIGH signal with a direction, else Hold."""
    percent = F.when(confidence <= 1.0, confidence * 100).otherwise(confidence)
    acts = (signal == "HIGH") & (percent >= threshold * 100)
    return (F.when(acts & (canonical == "bullish"), "Bullish")
            .when(acts & (canonical == "bearish"), "Bearish").otherwise("Hold"))


def trade_result(entry: Column, exit_: Column, side: Column, cut_loss: Column,
                 lot: int = fv.LOT_SIZE) -> Column:
    """Struct (pnl_usd, return_pct, trade_outcome) of one trade.

    Past the cut-loss level the P&L is that of the level, while the return stays the raw one.
    """
    priced = (entry > 0) & exit_.isNotNull() & (exit_ != 0)
    side_sign = F.when(side == "Bullish", 1).when(side == "Bearish", -1)
    raw = move_pct(entry, exit_)
    effective = raw * side_sign
    stopped = cut_loss.isNotNull() & (cut_loss != 0) & (
        ((side == "Bullish") & (exit_ < cut_loss)) | ((side == "Bearish") & (exit_ > cut_loss)))
    filled = F.when(stopped, cut_loss).otherwise(exit_)
    active = side_sign.isNotNull() & priced
    outcome = (F.when(side_sign.isNull(), "hold").when(~F.coalesce(priced, F.lit(False)), "pending")
               .when(stopped, "cut-loss").when(F.abs(effective) < fv.NEUTRAL_RETURN_PCT, "neutral")
               .when(effective > 0, "win").when(effective <= -fv.CUT_LOSS_RETURN_PCT, "cut-loss")
               .otherwise("loss"))
    return F.struct(
        F.when(active, half_up((filled - entry) * side_sign * lot, 2)).otherwise(0.0).alias("pnl_usd"),
        F.when(active, half_up(raw, 4)).otherwise(0.0).alias("return_pct"),
        outcome.alias("trade_outcome"))


def cut_loss_price(entry: Column, canonical: Column, stop_pct: Column) -> Column:
    """Price at which the thesis is invalid; NULL for a neutral direction."""
    share = F.coalesce(stop_pct, F.lit(fv.DEFAULT_STOP_PCT)) / 100
    return F.when(sign(canonical) != 0, half_up(entry * (1 - sign(canonical) * share), 4))


def outcome(canonical: Column, move: Column, entry: Column | None = None,
            cut_loss: Column | None = None, exit_: Column | None = None) -> Column:
    """correct / incorrect by direction alone; cut-loss first when the exit reached the level."""
    right = (((canonical == "bullish") & (move > 0)) | ((canonical == "bearish") & (move < 0))
             | ((canonical == "neutral") & (F.abs(move) < 1.0)))
    verdict = F.when(right, "correct").when(move.isNotNull(), "incorrect")
    if cut_loss is None:
        return verdict
    reached = (entry > 0) & (((canonical == "bullish") & (exit_ <= cut_loss))
                             | ((canonical == "bearish") & (exit_ >= cut_loss)))
    return F.when(reached, "cut-loss").otherwise(verdict)


def net_result(entry: Column, exit_: Column, direction_: Column, commodity: Column,
               lot: int = fv.LOT_SIZE, double_slippage: bool = True) -> Column:
    """Struct (cost_usd, pnl_net, return_net) after slippage and spread.

    Slippage moves both prices and is part of the cost as well, as in the published results;
    ``double_slippage=False`` counts it once. Whatever is not bullish is costed as a short.
    """
    slip = entry * fv.SLIPPAGE
    long_side = F.when(direction(direction_) == "bullish", 1).otherwise(-1)
    net_entry = entry + slip * long_side
    net_exit = exit_ - slip * long_side
    spread = lookup(fv.SPREAD_COSTS, commodity, fv.DEFAULT_SPREAD)
    cost = (spread * 2 + (slip * 2 if double_slippage else 0)) * lot
    priced = (entry > 0) & (exit_ != 0)
    return F.struct(
        F.when(priced, half_up(cost, 4)).alias("cost_usd"),
        F.when(priced, half_up((net_exit - net_entry) * long_side * lot - cost, 2)).alias("pnl_net"),
        F.when(priced, half_up((net_exit - net_entry) * long_side / net_entry * 100, 4))
        .alias("return_net"))


def action_label(trade_status: Column, direction_: Column) -> Column:
    """BUY / SELL / HOLD for the tracker."""
    name = F.lower(F.coalesce(direction_, F.lit("")))
    return (F.when(F.coalesce(trade_status, F.lit("HOLD")) == "HOLD", "HOLD")
            .when(name.isin("bullish", "rise"), "BUY").when(name.isin("bearish", "fall"), "SELL")
            .otherwise("HOLD"))


def percent_confidence(value: Column) -> Column:
    return F.coalesce(F.when(value <= 1.0, F.round(value * 100, 1)).otherwise(F.round(value, 1)),
                      F.lit(0.0))


def evidence_label(date: Column, cutoff) -> Column:
    """LIVE from the cutoff date on, BACKTEST before."""
    return F.when(date >= F.lit(cutoff).cast("date"), "LIVE").otherwise("BACKTEST")


def magnitude_label(high_prob: Column) -> Column:
    return F.when(high_prob >= 0.30, "HIGH").when(high_prob >= 0.15, "MEDIUM").otherwise("LOW")


def move_bucket(label: Column) -> Column:
    return F.when(label == "HIGH", ">3%").when(label == "MEDIUM", "1-3%").otherwise("<1%")


def live_confidence(p: Column) -> Column:
    """Display confidence of a live signal: 35-49, 50-70 and 70-95 by pieces."""
    pieces = (F.when(p < 0.40, 35 + p / 0.40 * 14).when(p < 0.60, 50 + (p - 0.40) / 0.20 * 20)
              .otherwise(70 + (p - 0.60) / 0.40 * 25))
    return F.round(F.least(F.greatest(pieces, F.lit(35.0)), F.lit(95.0)), 1)


def history_confidence(p: Column, label: Column, canonical: Column, n_relevant: Column) -> Column:
    """Display confidence of a backfilled signal, 35-95."""
    by_label = F.when(label == "HIGH", 1.4).when(label == "MEDIUM", 1.2).otherwise(1.0)
    by_direction = F.when(canonical == "neutral", 0.6).otherwise(1.0)
    by_articles = 0.7 + F.least(n_relevant / 15.0, F.lit(1.0)) * 0.3
    return F.least(F.greatest(p * 4.5 * by_label * by_direction * by_articles, F.lit(35.0)),
                   F.lit(95.0))


def strength(canonical: Column, confidence: Column) -> Column:
    directional = canonical != "neutral"
    return (F.when(directional & (confidence >= 70), "Strong")
            .when(directional & (confidence >= 50), "Moderate").otherwise("Weak"))


def bias(canonical: Column, confidence: Column) -> Column:
    clear = confidence >= 50
    return (F.when((canonical == "bullish") & clear, "Bullish — Consider Long")
            .when(canonical == "bullish", "Bullish lean — Low confidence, monitor only")
            .when((canonical == "bearish") & clear, "Bearish — Consider Short")
            .when(canonical == "bearish", "Bearish lean — Low confidence, monitor only")
            .otherwise("Neutral — Hold"))


def pct_text(value: Column) -> Column:
    """Whole percents of a 0-1 value."""
    return F.concat(F.round(value * 100, 0).cast("int").cast("string"), F.lit("%"))
