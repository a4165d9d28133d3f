"""Trade decisions, settlement and repair over the predictions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.config import with_commodity_config
from newsignal.functions import trading
from newsignal.functions.numbers import half_up
from newsignal.operators.asof import two_tier_close
from newsignal.operators.keyed import insert_absent
from newsignal.operators.quality import shared_prices
from newsignal.session import checkpointed


def month_of(date: str = "prediction_date") -> Column:
    return F.date_format(date, "yyyy-MM")


def trades_in_months(predictions: DataFrame) -> DataFrame:
    """(month, n_trades): distinct date and commodity pairs with status TRADE."""
    return (predictions.filter("trade_status = 'TRADE'").groupBy(month_of().alias("month"))
            .agg(F.count_distinct("prediction_date", "commodity").alias("n_trades")))


def trades_since(predictions: DataFrame, month_start) -> DataFrame:
    """Trades of the current month as one row."""
    current = (F.col("trade_status") == "TRADE") & (
        F.col("prediction_date") >= F.lit(month_start).cast("date"))
    return predictions.filter(current).agg(
        F.count_distinct("prediction_date", "commodity").alias("trades_this_month"))


def _quality(threshold: float) -> tuple[Column, Column, Column, Column]:
    """The first four rules; each is true when the signal passes it."""
    event = F.coalesce(F.col("event_type"), F.lit(""))
    return (F.coalesce(F.col("signal") == "HIGH", F.lit(False)), F.col("confidence") >= threshold,
            trading.expected_move_pct(F.col("expected_move")) >= fv.MIN_EXPECTED_MOVE_PCT,
            ~event.isin(fv.LOW_IMPACT_EVENTS))


def decide_trades(signals: DataFrame, taken: DataFrame | None = None,
                  threshold: float = fv.TRADE_CONFIDENCE, budget: int = fv.MAX_TRADES_PER_MONTH,
                  rules: str = "full") -> DataFrame:
    """Add ``trade_status``, ``reason``, ``trade_number`` and ``remaining_budget`` to signals.

    The first failing rule decides. Qualifying signals of a month are numbered by date, commodity and
    id until the budget is used; ``taken`` holds trades of earlier runs per month. Only the few trades
    of a month are ranked and kept as one short array per month. The months of the calendar are a small
    table (at most ``budget`` ids each), which is broadcast: signals are not shuffled by month.
    ``rules="simple"`` is the historical rule: HIGH and confident, no budget.
    """
    high, confident, moving, fundamental = _quality(threshold)
    if rules == "simple":
        status = F.when(high & confident, "TRADE").otherwise("HOLD")
        return signals.withColumn("trade_status", status)

    dated = signals.drop("trade_status").withColumn("_month", month_of())
    place = F.struct("prediction_date", "commodity", "id")
    order = Window.partitionBy("_month").orderBy("prediction_date", "commodity", "id")
    ranked = (dated.filter(high & confident & moving & fundamental)
              .select("_month", "prediction_date", "commodity", "id", F.row_number().over(order).alias("_k"))
              .filter(F.col("_k") <= budget))
    chosen = ranked.groupBy("_month").agg(F.array_sort(F.collect_list(place)).alias("_chosen"))
    joined = dated.join(F.broadcast(chosen), "_month", "left")
    if taken is not None:
        joined = joined.join(taken.select(F.col("month").alias("_month"), F.col("n_trades").alias("_taken")),
                             "_month", "left")
    else:
        joined = joined.withColumn("_taken", F.lit(0))
    taken_before = F.coalesce(F.col("_taken"), F.lit(0)).cast("int")
    left = F.greatest(F.lit(budget) - taken_before, F.lit(0))
    trades = F.slice(F.coalesce(F.col("_chosen"), F.array().cast(
        "array<struct<prediction_date:date,commodity:string,id:bigint>>")), F.lit(1), left)
    joined = joined.withColumn("_trades", trades).withColumn(
        "_before", F.size(F.filter("_trades", lambda t: t < place))).withColumn(
        "_is_trade", F.array_contains("_trades", place))
    remaining = F.greatest(left - F.col("_before"), F.lit(0))
    number = F.when(F.col("_is_trade"), taken_before + F.col("_before") + 1)
    side = F.initcap(trading.direction(F.col("direction")))
    percent = trading.pct_text(F.col("confidence"))
    reason = (
        F.when(~high, F.concat(F.lit("Signal is "), "signal",
                               F.lit(" — only HIGH signals qualify for fundamental trades")))
        .when(~confident, F.concat(F.lit("Confidence "), percent, F.lit(" below "),
                                   trading.pct_text(F.lit(threshold)),
                                   F.lit(" threshold — monitor but do not act")))
        .when(~moving, F.concat(F.lit("Expected move "), "expected_move",
                                F.lit(" too small for a fundamental trade")))
        .when(~fundamental, F.concat(F.lit('Event type "'), "event_type",
                                     F.lit('" is not a market-moving fundamental catalyst')))
        .when(~F.col("_is_trade"), F.lit(
            f"Monthly trade budget reached ({budget} trades). Review existing positions."))
        .otherwise(F.concat(F.lit("HIGH-impact "), side, F.lit(" signal with "), percent,
                            F.lit(" confidence. Expected move: "), "expected_move", F.lit("."))))
    return joined.withColumns({
        "trade_status": F.when(~high, "HOLD").when(F.col("_is_trade"), "TRADE").otherwise("WATCH"),
        "reason": reason, "trade_number": number,
        "remaining_budget": F.when(F.col("_is_trade"), remaining - 1).otherwise(remaining),
    }).drop("_month", "_chosen", "_taken", "_trades", "_before", "_is_trade")


def _monthly_best(predictions: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` most confident HIGH rows with an entry price of every month."""
    order = Window.partitionBy("_month").orderBy(
        F.coalesce("confidence", F.lit(0.0)).desc(), "prediction_date", "id")
    return (predictions.filter("signal = 'HIGH' and entry_price is not null")
            .withColumn("_month", month_of()).withColumn("_k", F.row_number().over(order))
            .filter(F.col("_k") <= cap).drop("_k"))


def monthly_cap(predictions: DataFrame, cap: int = fv.MAX_TRADES_PER_MONTH) -> DataFrame:
    """Keep the most confident priced HIGH rows of a month; all other rows pass through."""
    others = predictions.filter("coalesce(signal, '') <> 'HIGH' or entry_price is null")
    return _monthly_best(predictions, cap).drop("_month").unionByName(others)


def recompute_trades(predictions: DataFrame, cap: int = fv.MAX_TRADES_PER_MONTH) -> DataFrame:
    """Set trade_direction, return_pct, trade_outcome and pnl_usd of every row.

    Rows with status TRADE and, among the others, the capped HIGH rows get a side; the rest is Hold,
    and the P&L of Hold rows is left as stored. The capped ids are at most ``cap`` for each month of the
    calendar, so they are broadcast.
    """
    open_rows = predictions.filter("coalesce(trade_status, '') <> 'TRADE'")
    capped = _monthly_best(open_rows, cap).groupBy("_month").agg(F.collect_list("id").alias("_ids"))
    joined = predictions.withColumn("_month", month_of()).join(F.broadcast(capped), "_month", "left")
    acts = (F.coalesce(F.col("trade_status") == "TRADE", F.lit(False))
            | F.coalesce(F.array_contains("_ids", F.col("id")), F.lit(False)))
    side = F.when(acts, trading.trade_direction(
        F.coalesce("signal", F.lit("LOW")), F.col("direction"),
        F.coalesce("confidence", F.lit(0.0)))).otherwise("Hold")
    priced = F.col("entry_price").isNotNull() & F.col("exit_price").isNotNull()
    result = trading.trade_result(F.col("entry_price"), F.col("exit_price"), F.col("trade_direction"),
                                  F.col("cut_loss_price"))
    stored = F.col("pnl_usd") if "pnl_usd" in predictions.columns else F.lit(None).cast("double")
    return (joined.withColumn("direction", trading.direction(F.col("direction")))
            .withColumn("trade_direction", side).withColumn("_r", result)
            .withColumns({
                "return_pct": F.when(priced, F.col("_r.return_pct")).otherwise(0.0),
                "trade_outcome": F.when(priced, F.col("_r.trade_outcome")).otherwise("pending"),
                "pnl_usd": F.when(F.col("trade_direction") == "Hold", stored)
                .when(priced, F.col("_r.pnl_usd")).otherwise(0.0)})
            .drop("_month", "_ids", "_r"))


def settle(predictions: DataFrame, prices: DataFrame, market: DataFrame, today) -> DataFrame:
    """Backfill of actuals: fill prices, move, outcome and P&L of rows that are still open.

    Only open rows older than a day take part in the lookups; the others pass through unchanged.
    Stored moves and outcomes are never overwritten.
    """
    old = F.col("prediction_date") <= F.date_sub(F.lit(today).cast("date"), 1)
    is_open = F.coalesce(old & (F.col("outcome").isNull() | F.col("entry_price").isNull()
                                | F.col("exit_price").isNull()), F.lit(False))
    columns = predictions.columns
    rows = with_commodity_config(predictions.filter(is_open), "price_symbol", "ticker_yf", "stop_pct") \
        if "ticker_yf" not in columns else with_commodity_config(
            predictions.filter(is_open), "price_symbol", "stop_pct")
    rows = two_tier_close(rows, prices, market, "prediction_date", "_near")
    rows = two_tier_close(rows, prices, market, "prediction_date", "_next", strictly_after=True)
    canonical = trading.direction(F.col("direction"))
    no_entry, no_exit = F.col("entry_price").isNull(), F.col("exit_price").isNull()
    entry = F.coalesce("entry_price", "_near_price")
    found_exit = F.coalesce("exit_price", "_next_price")
    failed = (no_entry & F.col("_near_price").isNull()) | (no_exit & F.col("_next_price").isNull())
    same = F.coalesce(F.abs(found_exit - entry) < fv.SAME_PRICE_TOLERANCE, F.lit(False))
    level = F.when(no_entry & F.col("_near_price").isNotNull() & (canonical != "neutral"),
                   trading.cut_loss_price(entry, canonical, F.col("stop_pct"))) \
        .otherwise(F.col("cut_loss_price"))
    done = entry.isNotNull() & found_exit.isNotNull() & ~same & (entry > 0)
    rows = rows.withColumns({
        "_entry": entry, "_exit": found_exit, "_level": level, "_done": done, "_same": same,
        "_quality": F.when(same, "same_day_price_error").when(failed, "price_fetch_failed")
        .when(no_entry, "ok").otherwise(F.col("data_quality"))})
    rows = rows.withColumn("_move", F.when(F.col("_done"), half_up(
        trading.move_pct(F.col("_entry"), F.col("_exit")), 2)))
    verdict = trading.outcome(canonical, F.col("_move"), F.col("_entry"), F.col("_level"), F.col("_exit"))
    settled = {
        "entry_price": F.col("_entry"),
        "entry_price_source": F.when(no_entry, F.coalesce("_near_price_source", "entry_price_source"))
        .otherwise(F.col("entry_price_source")),
        "exit_price": F.when(~F.col("_same"), F.col("_exit")),
        "exit_price_source": F.when(no_exit, F.coalesce("_next_price_source", "exit_price_source"))
        .otherwise(F.col("exit_price_source")),
        "cut_loss_price": F.col("_level"),
        "actual_move": F.coalesce("actual_move", "_move"),
        "outcome": F.coalesce("outcome", F.when(F.col("_done"), verdict)),
        "pnl_usd": F.when(F.col("_done"), half_up(
            (F.col("_exit") - F.col("_entry")) * fv.LOT_SIZE * trading.sign(canonical), 2))
        .otherwise(F.col("pnl_usd")),
        "data_quality": F.when(F.col("_done"), F.coalesce("_quality", F.lit("ok")))
        .otherwise(F.col("_quality")),
    }
    changed = rows.select(*[settled[c].alias(c) if c in settled else F.col(c) for c in columns])
    return predictions.filter(~is_open).unionByName(changed)


def _same_day(predictions: DataFrame) -> DataFrame:
    suspect = (F.abs(F.col("exit_price") - F.col("entry_price")) < fv.SAME_PRICE_TOLERANCE) & (
        F.coalesce("data_quality", F.lit("")) != "repaired_ok")
    return predictions.withColumn("_suspect", F.coalesce(suspect, F.lit(False)))


def _shared(predictions: DataFrame) -> DataFrame:
    hits = shared_prices(predictions).select("id", F.lit(True).alias("_hit"))
    return predictions.join(hits, "id", "left").withColumn(
        "_suspect", F.coalesce("_hit", F.lit(False))
        & (F.coalesce("data_quality", F.lit("")) != "repaired_ok")).drop("_hit")


def _refetch(flagged: DataFrame, prices: DataFrame, market: DataFrame, reason: str) -> DataFrame:
    """Clear the suspect rows and fill them again from the two price tiers."""
    columns = [c for c in flagged.columns if c != "_suspect"]
    rows = with_commodity_config(flagged.filter("_suspect"), "price_symbol", "ticker_yf")
    rows = two_tier_close(rows, prices, market, "prediction_date", "_near")
    rows = two_tier_close(rows, prices, market, "prediction_date", "_next", strictly_after=True)
    entry, exit_ = F.col("_near_price"), F.col("_next_price")
    status = (F.when(entry.isNull() | exit_.isNull(), "repair_fetch_failed")
              .when(F.abs(exit_ - entry) < fv.SAME_PRICE_TOLERANCE, "repair_still_same_price")
              .otherwise("repaired_ok"))
    rows = rows.withColumn("_status", status)
    fixed = F.col("_status") == "repaired_ok"
    move = half_up(trading.move_pct(entry, exit_), 2)
    rows = rows.withColumn("_move", F.when(fixed, move))
    canonical = trading.direction(F.col("direction"))
    repaired = {
        "entry_price": F.when(fixed, entry), "exit_price": F.when(fixed, exit_),
        "entry_price_source": F.when(fixed, F.col("_near_price_source"))
        .otherwise(F.col("entry_price_source")),
        "exit_price_source": F.when(fixed, F.col("_next_price_source"))
        .otherwise(F.col("exit_price_source")),
        "actual_move": F.col("_move"),
        "outcome": trading.outcome(canonical, F.col("_move")),
        "pnl_usd": F.when(fixed, half_up((exit_ - entry) * fv.LOT_SIZE * trading.sign(canonical), 2)),
        "data_quality": F.col("_status"),
        "repair_reason": F.lit(reason),
    }
    changed = rows.select(*[repaired[c].alias(c) if c in repaired else F.col(c) for c in columns])
    return flagged.filter("not _suspect").drop("_suspect").unionByName(changed)


def repair_prices(predictions: DataFrame, prices: DataFrame, market: DataFrame) -> DataFrame:
    """Repair rows with equal entry and exit, then rows that share the price of another commodity.

    The result is the whole table with a ``repair_reason`` for touched rows; looking at it without
    writing is the dry run. Repaired rows are not picked up again.
    """
    # rows are split and joined with themselves in both steps, so each step starts from a table
    start = checkpointed(predictions.withColumn("repair_reason", F.lit(None).cast("string")))
    first = checkpointed(_refetch(_same_day(start), prices, market, "same_day"))
    return _refetch(_shared(first), prices, market, "shared_dubai_price")


def assemble_predictions(signals: DataFrame, prices: DataFrame, market: DataFrame,
                         existing: DataFrame | None = None,
                         min_articles: int = fv.MIN_ARTICLES) -> DataFrame:
    """Signals of a day to prediction rows, with entry price, cut-loss level and trade decision.

    ``signals``: id, prediction_date, commodity, signal, direction, high_prob, confidence, scaled_conf,
    expected_move, headline, event_type, impact_score, article_count. Days with too few articles are
    not logged; rows whose date and commodity are stored already are left out.
    """
    rows = with_commodity_config(signals.filter(F.col("article_count") >= min_articles),
                                 "ticker", "ticker_yf", "price_symbol", "price_unit", "price_currency",
                                 "stop_pct")
    rows = two_tier_close(rows, prices, market, "prediction_date", "entry")
    nonzero = [F.when(F.col(c) != 0, F.col(c)) for c in ("high_prob", "confidence", "scaled_conf")]
    rows = rows.withColumns({
        "direction": trading.direction(F.col("direction")),
        "confidence": trading.unit_confidence(F.coalesce(*nonzero, F.lit(0.0)))})
    rows = rows.withColumn("cut_loss_price", trading.cut_loss_price(
        F.col("entry_price"), F.col("direction"), F.col("stop_pct")))
    taken = trades_in_months(existing) if existing is not None else None
    decided = decide_trades(rows, taken).withColumn("data_quality", F.lit("ok"))
    out = decided.select(
        "id", "prediction_date", "commodity", "ticker", "ticker_yf", "signal", "direction", "confidence",
        "expected_move", "headline", "entry_price", "entry_price_source", "price_currency", "price_unit",
        "data_quality", "trade_status", "trade_number", "event_type", "cut_loss_price", "impact_score")
    if existing is None:
        return out
    return insert_absent(existing, out, ["prediction_date", "commodity"], [F.col("id")])
