"""Registered queries: trade decisions, settlement, setups, metrics, curves and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsignal.functions import trading
from newsignal.operators import listings, metrics, quality, setups, trades
from newsignal.session import checkpointed
from newsignal.sources import adapters

TODAY = "2001-08-01"
CUTOFF = "2001-01-01"
TRADE_COLUMNS = ["trade_direction", "return_pct", "trade_outcome", "pnl_usd"]


def _traded(spark, folder):
    return trades.recompute_trades(adapters.settled_predictions(spark, folder))


def _evaluated(spark, folder):
    return metrics.evaluation_rows(adapters.settled_predictions(spark, folder))


def trade_decisions(spark, folder):
    return trades.decide_trades(adapters.predictions(spark, folder)).select(
        "id", "trade_status", "reason", "trade_number", "remaining_budget")


def trade_decisions_simple(spark, folder):
    return trades.decide_trades(adapters.predictions(spark, folder), rules="simple").select(
        "id", "trade_status")


def trades_this_month(spark, folder):
    return trades.trades_since(adapters.predictions(spark, folder), "2001-07-01")


def trades_per_month(spark, folder):
    return trades.trades_in_months(adapters.predictions(spark, folder))


def canonical_direction(spark, folder):
    return adapters.predictions(spark, folder).groupBy(
        "direction", trading.direction(F.col("direction")).alias("canonical")).agg(
        F.count(F.lit(1)).alias("n"))


def trade_sides(spark, folder):
    side = trading.trade_direction(F.col("signal"), trading.direction(F.col("direction")),
                                   F.col("confidence"))
    return adapters.predictions(spark, folder).select("id", side.alias("trade_direction"))


def trade_results(spark, folder):
    """P&L of every priced prediction taken in its own direction."""
    side = F.initcap(trading.direction(F.col("direction")))
    side = F.when(side == "Neutral", "Hold").otherwise(side)
    result = trading.trade_result(F.col("entry_price"), F.col("exit_price"), side,
                                  F.col("cut_loss_price"))
    return adapters.priced_predictions(spark, folder).select("id", result.alias("r")).select("id", "r.*")


def cut_loss_levels(spark, folder):
    return adapters.priced_predictions(spark, folder).select("id", "cut_loss_price")


def outcomes(spark, folder):
    return adapters.settled_predictions(spark, folder).select("id", "actual_move", "outcome", "pnl_usd")


def monthly_cap(spark, folder):
    return trades.monthly_cap(adapters.priced_predictions(spark, folder)).select("id", "signal", "confidence")


def recompute_trades(spark, folder):
    return _traded(spark, folder).select("id", "direction", *TRADE_COLUMNS)


def open_predictions(spark, folder):
    """Priced predictions whose outcome is open but for a few."""
    return adapters.priced_predictions(spark, folder).withColumns({
        "exit_price_source": F.lit(None).cast("string"), "actual_move": F.lit(None).cast("double"),
        "outcome": F.when(F.col("id") % 37 == 0, "correct"), "pnl_usd": F.lit(None).cast("double"),
        "data_quality": F.lit(None).cast("string")})


def settle_predictions(spark, folder):
    """Backfill over priced predictions whose outcome is open."""
    done = trades.settle(open_predictions(spark, folder), adapters.prices(spark, folder), adapters.market_prices(spark, folder), TODAY)
    return done.select("id", "entry_price", "entry_price_source", "exit_price", "exit_price_source",
                       "cut_loss_price", "actual_move", "outcome", "pnl_usd", "data_quality")


def repair_prices(spark, folder):
    rows = adapters.settled_predictions(spark, folder).withColumn(
        "exit_price_source", F.col("entry_price_source"))
    fixed = trades.repair_prices(rows, adapters.prices(spark, folder),
                                 adapters.market_prices(spark, folder))
    return fixed.filter("repair_reason is not null").select(
        "id", "repair_reason", "entry_price", "exit_price", "actual_move", "outcome", "pnl_usd",
        "data_quality")


def evaluation_rows(spark, folder):
    return _evaluated(spark, folder).select("id", "return_pct", "predicted_direction", "actual_direction",
                                            "is_correct", "status")


def accuracy_summary(spark, folder):
    return metrics.accuracy_summary(_evaluated(spark, folder))


def accuracy_breakdown(spark, folder):
    return metrics.accuracy_by(_evaluated(spark, folder), "commodity", "signal")


def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_evaluated(spark, folder))


def trading_metrics(spark, folder):
    return metrics.trading_metrics(_traded(spark, folder))


def value_at_risk(spark, folder):
    return metrics.value_at_risk(metrics.resolved_trades(_traded(spark, folder)))


def risk_ratios(spark, folder):
    """Sharpe and Sortino in the three published conventions."""
    done = checkpointed(adapters.settled_predictions(spark, folder))
    history = done.filter(F.col("outcome").isin("correct", "incorrect", "cut-loss"))
    variants = [
        ("trades", metrics.risk_ratios(metrics.resolved_trades(trades.recompute_trades(done)),
                                       F.col("pnl_usd"), F.col("entry_price"))),
        ("history", metrics.risk_ratios(history, F.round("pnl_usd", 0), F.round("entry_price", 3),
                                        periods=104)),
        ("report", metrics.risk_ratios(done, F.col("pnl_usd"), F.col("entry_price"), population=True))]
    rows = [df.withColumn("variant", F.lit(name)) for name, df in variants]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def payoff(spark, folder):
    return metrics.payoff(adapters.settled_predictions(spark, folder))


def _tracker(spark, folder):
    return metrics.tracker_rows(_traded(spark, folder), CUTOFF)


def tracker_rows(spark, folder):
    return _tracker(spark, folder).select(
        "id", "outcome", "trade_status", "signal_type", "signal_label", "confidence_pct", "cost_usd",
        "pnl_net", "return_net")


def tracker_summary(spark, folder):
    return metrics.tracker_summary(_tracker(spark, folder))


def tracker_summary_live(spark, folder):
    return metrics.tracker_summary(_tracker(spark, folder), "LIVE")


def monthly_pnl(spark, folder):
    return metrics.monthly_pnl(metrics.tracker_resolved(_tracker(spark, folder)))


def history_kpis(spark, folder):
    return metrics.history_kpis(adapters.settled_predictions(spark, folder))


def period_report(spark, folder):
    return metrics.period_report(adapters.settled_predictions(spark, folder), "1999-01-01")


def accuracy_by_commodity(spark, folder):
    return metrics.accuracy_by_commodity(adapters.settled_predictions(spark, folder))


def rolling_accuracy(spark, folder):
    return metrics.rolling_accuracy(adapters.settled_predictions(spark, folder)).select(
        "id", F.round("rolling_acc", 6).alias("rolling_acc"))


def rolling_evaluation(spark, folder):
    return metrics.rolling_evaluation(_evaluated(spark, folder)).select(
        "id", F.round("rolling_acc", 6).alias("rolling_acc"))


def cumulative_pnl(spark, folder):
    return metrics.cumulative_pnl(adapters.settled_predictions(spark, folder)).withColumn(
        "cum_pnl", F.round("cum_pnl", 2))


def drawdown_curve(spark, folder):
    rows = metrics.tracker_resolved(_tracker(spark, folder))
    return metrics.equity_curve(rows, "pnl_net").select(
        "id", F.round("equity", 2).alias("equity"), F.round("peak", 2).alias("peak"),
        F.round("drawdown", 2).alias("drawdown"))


def best_worst_calls(spark, folder):
    return listings.best_and_worst(adapters.settled_predictions(spark, folder)).select(
        "side", "id", "commodity", "pnl_usd")


def win_rates(spark, folder):
    return setups.win_rates(adapters.settled_predictions(spark, folder))


def recent_volatility(spark, folder):
    return setups.recent_volatility(adapters.settled_predictions(spark, folder)).withColumn(
        "zone_pct", F.round("zone_pct", 6))


def _setups(spark, folder):
    history = adapters.settled_predictions(spark, folder)
    signals = history.withColumn("scaled_conf", F.col("confidence") * 100)
    return setups.build_setups(signals, history)


def trade_setups(spark, folder):
    return _setups(spark, folder).select(
        "id", "trade_direction", "entry_low", "entry_high", "target_price", "target_move_pct", "stop_loss",
        "risk_usd", "reward_usd", "risk_reward", "win_rate", "expected_value", "rating", "is_best",
        "rationale")


def priced_setups(spark, folder):
    """Setups of all signals, entry prices looked up."""
    history = adapters.settled_predictions(spark, folder)
    signals = adapters.predictions(spark, folder).withColumn("scaled_conf", F.col("confidence") * 100)
    made = setups.build_all_setups(signals, adapters.prices(spark, folder), adapters.market_prices(spark, folder), history)
    return made.select("id", "entry_price", "entry_price_source", "trade_direction", "target_price", "stop_loss", "risk_usd", "reward_usd",
                       "risk_reward", "win_rate", "expected_value", "rating", "is_best")


def setup_summary(spark, folder):
    return setups.setup_summary(_setups(spark, folder))


def top_setups(spark, folder):
    return setups.rank_setups(_setups(spark, folder), best_only=True, limit=20).select(
        "id", "expected_value", "risk_reward")


def historical_setups(spark, folder):
    return setups.historical_setups(adapters.settled_predictions(spark, folder), TODAY, 2000).select(
        "id", "target_price", "stop_loss", F.round("risk_usd", 2).alias("risk_usd"),
        F.round("reward_usd", 2).alias("reward_usd"), "risk_reward", "confidence_pct")


def quality_report(spark, folder):
    return quality.run_all_checks(adapters.settled_predictions(spark, folder))


def quality_totals(spark, folder):
    return quality.status_totals(quality_report(spark, folder))


def price_source_breakdown(spark, folder):
    return quality.price_source_breakdown(adapters.settled_predictions(spark, folder))


def win_rate_by_band(spark, folder):
    return quality.win_rate_by_band(adapters.settled_predictions(spark, folder))


def violation_sample(spark, folder):
    sampled = quality.violation_sample(
        quality.same_price_rows(adapters.settled_predictions(spark, folder)))
    return sampled.select("n_rows", F.size("sample").alias("n_sample"),
                          F.array_join(F.transform("sample", lambda r: r["id"].cast("string")), ",")
                          .alias("sample_ids"))


def history_table(spark, folder):
    return listings.history_table(adapters.settled_predictions(spark, folder), TODAY)


def filtered_predictions(spark, folder):
    rows = _evaluated(spark, folder)
    parts = [
        ("pending", listings.filter_predictions(rows, outcome="pending", first="1996-01-01")),
        ("brent cut-loss", listings.filter_predictions(rows, commodity="Brent Dated (PCAAS00)",
                                                       outcome="cut-loss")),
        ("wrong high", listings.filter_predictions(rows, signal="HIGH", result="wrong",
                                                   last="1999-12-31"))]
    named = [df.select(F.lit(name).alias("filter"), "id") for name, df in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


QUERIES = {f.__name__: f for f in [
    trade_decisions, trade_decisions_simple, trades_this_month, trades_per_month, canonical_direction,
    trade_sides, trade_results, cut_loss_levels, outcomes, monthly_cap, recompute_trades,
    settle_predictions, repair_prices, evaluation_rows, accuracy_summary, accuracy_breakdown,
    confusion_matrix, trading_metrics, value_at_risk, risk_ratios, payoff, tracker_rows, tracker_summary,
    tracker_summary_live, monthly_pnl, history_kpis, period_report, accuracy_by_commodity,
    rolling_accuracy, rolling_evaluation, cumulative_pnl, drawdown_curve, best_worst_calls, win_rates,
    recent_volatility, trade_setups, priced_setups, setup_summary, top_setups, historical_setups, quality_report,
    quality_totals, price_source_breakdown, win_rate_by_band, violation_sample, history_table,
    filtered_predictions]}
