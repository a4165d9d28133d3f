"""Filters, listings and display projections over articles and predictions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.functions import rules, text
from newsignal.functions.trading import direction


def with_body(articles: DataFrame) -> DataFrame:
    return articles.filter(~text.is_blank(F.col("body_text")))


def body_counts(articles: DataFrame) -> DataFrame:
    empty = text.is_blank(F.col("body_text"))
    return articles.agg(F.count_if(empty).alias("n_empty"), F.count_if(~empty).alias("n_filled"))


def in_window(date: Column, first, last) -> Column:
    """Date inside the window; a missing date passes."""
    return date.isNull() | date.between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def quality_articles(articles: DataFrame, today, days: int = 7, limit: int = 10) -> DataFrame:
    """Newest articles with a real body and no routine report name in the headline."""
    title = F.lower(F.coalesce("headline", F.lit("")))
    wanted = (F.length(F.coalesce("body_text", F.lit(""))) > fv.REAL_NEWS_BODY_CHARS) & (
        F.to_date("published_at") >= F.date_sub(F.lit(today).cast("date"), days))
    routine = reduce(lambda a, b: a | b, [title.contains(w) for w in fv.QUALITY_EXCLUDED_WORDS])
    return newest(articles.filter(wanted & ~routine), limit)


def newest(rows: DataFrame, limit: int, date: str = "published_at", tie: str = "id") -> DataFrame:
    """Newest rows; a distributed top-k, not a full sort."""
    return rows.orderBy(F.col(date).desc(), F.col(tie).desc()).limit(limit)


def empty_body_worklist(articles: DataFrame, words: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Articles to refetch: no body, UUID id, optionally a word in the headline, newest first."""
    rows = articles.filter(text.is_blank(F.col("body_text")) & rules.is_uuid(F.col("id")))
    if words:
        title = F.lower(F.coalesce("headline", F.lit("")))
        rows = rows.filter(rules.any_keyword(title, [w.lower() for w in words]))
    ordered = rows.orderBy(F.col("published_at").desc(), F.col("id").desc())
    return ordered.limit(limit) if limit else ordered


def feed_listing(labelled: DataFrame, limit: int = 50) -> DataFrame:
    return newest(labelled, limit).select("id", "headline", "source", "published_at", "aligned_date",
                                          "label", "price_change", "url")


def report_listing(articles: DataFrame, report_name: str | None = None, content_id: str | None = None,
                   limit: int = 50) -> DataFrame:
    """Newest reports with optional filters; a filter on a column that is not there is ignored."""
    columns = set(articles.columns)
    rows = articles
    if report_name and "report_name" in columns:
        rows = rows.filter(F.lower("report_name") == report_name.lower())
    if content_id and "content_id" in columns:
        rows = rows.filter(F.col("content_id") == content_id)
    optional = [F.col(c) if c in columns else F.lit(None).cast("string").alias(c)
                for c in ("content_id", "content_type", "report_name")]
    return newest(rows, limit).select("id", "headline", "body_text", "source", "published_at", "url",
                                      *optional)


def filter_predictions(predictions: DataFrame, commodity: str | None = None, first=None, last=None,
                       outcome: str | None = None, signal: str | None = None,
                       result: str | None = None) -> DataFrame:
    """Report filters as one predicate; all of them reach the scan.

    ``outcome='pending'`` means no outcome yet; ``result`` is correct, wrong or pending over
    evaluated rows.
    """
    conditions = []
    if commodity:
        conditions.append(F.col("commodity") == commodity)
    if first:
        conditions.append(F.col("prediction_date") >= F.lit(first).cast("date"))
    if last:
        conditions.append(F.col("prediction_date") <= F.lit(last).cast("date"))
    if outcome == "pending":
        conditions.append(F.coalesce("outcome", F.lit("")) == "")
    elif outcome:
        conditions.append(F.lower("outcome") == outcome)
    if signal:
        conditions.append(F.col("signal") == signal)
    if result:
        conditions.append({"correct": F.coalesce(F.col("is_correct"), F.lit(False)),
                           "wrong": ~F.coalesce(F.col("is_correct"), F.lit(True)),
                           "pending": F.col("status") == "pending"}[result])
    return reduce(lambda df, condition: df.filter(condition), conditions, predictions)


def context_panels(articles: DataFrame, panels=fv.CONTEXT_PANELS, per_panel: int = 5,
                   order: str = "seq") -> DataFrame:
    """First headlines of every panel. The rank is limited per task before the shuffle."""
    title = F.lower(F.coalesce("headline", F.lit("")))
    rows = articles.select(order, "id", "headline",
                           F.explode(rules.matched_groups(title, panels)).alias("panel"))
    rank = F.row_number().over(Window.partitionBy("panel").orderBy(order))
    return (rows.withColumn("position", rank).filter(F.col("position") <= per_panel)
            .select("panel", "position", "id", F.substring("headline", 1, 90).alias("headline")))


def _signed(value: Column, digits: int, unit: str = "") -> Column:
    number = F.abs(F.round(value, digits)).cast(f"decimal(18,{digits})").cast("string")
    return F.concat(F.when(value >= 0, "+").otherwise("-"), number, F.lit(unit))


def history_table(predictions: DataFrame, today) -> DataFrame:
    """Display strings of the signal history, with a reason for every open outcome."""
    day = F.col("prediction_date")
    result, quality = F.lower(F.trim(F.coalesce("outcome", F.lit("")))), F.coalesce("data_quality", F.lit(""))
    canonical = direction(F.col("direction"))
    shown = (F.when(result == "correct", "✓ Correct").when(result == "cut-loss", "✗ Cut-Loss")
             .when(result == "incorrect", "✗ Incorrect")
             .when(day == F.lit(today).cast("date"), "⏳ Today — awaiting close")
             .when(F.weekday(day) == 5, "📅 Saturday — no market")
             .when(F.weekday(day) == 6, "📅 Sunday — no market")
             .when(quality.contains("holiday"), "📅 Holiday — no market")
             .when(quality.contains("price_fetch_failed"), "⚠ Price unavailable")
             .otherwise("⏳ Pending"))
    move, dash = F.col("actual_move"), F.lit("—")
    arrow = F.when(move > 0, "▲ ").when(move < 0, "▼ ").otherwise("→ ")
    pnl = F.round("pnl_usd", 0)
    title = F.coalesce("headline", dash)

    def price(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("$"), F.round(name, 3).cast("decimal(18,3)").cast("string")), dash)

    return predictions.select(
        "id", "prediction_date", "commodity", "signal",
        F.when(canonical == "bullish", "▲ Bullish").when(canonical == "bearish", "▼ Bearish")
        .otherwise("→ Neutral").alias("direction_text"),
        F.concat(F.round(F.col("confidence") * 100, 1).cast("decimal(8,1)").cast("string"), F.lit("%"))
        .alias("confidence_text"),
        F.coalesce(F.concat(arrow, _signed(move, 2, "%")), dash).alias("move_text"),
        F.coalesce(F.concat(F.lit("$"), F.when(pnl >= 0, "+").otherwise("-"),
                            F.abs(pnl).cast("bigint").cast("string")), dash).alias("pnl_text"),
        price("entry_price").alias("entry_text"), price("exit_price").alias("exit_text"),
        shown.alias("outcome_text"),
        F.when(F.length(title) > 90, F.concat(F.substring(title, 1, 90), F.lit("…"))).otherwise(title)
        .alias("headline_text"))


def best_and_worst(predictions: DataFrame, n: int = 5) -> DataFrame:
    """Top and bottom calls by P&L: two distributed top-k."""
    rows = predictions.filter("outcome is not null and pnl_usd is not null").select(
        "id", "prediction_date", "commodity", "signal", "actual_move", "pnl_usd")
    best = rows.orderBy(F.col("pnl_usd").desc(), "id").limit(n).withColumn("side", F.lit("best"))
    worst = rows.orderBy(F.col("pnl_usd"), "id").limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def key_articles(scored: DataFrame, first: int = 20, n: int = 8) -> DataFrame:
    """Key articles of a day: by probability plus impact among the first ones that arrived."""
    order = Window.partitionBy("day").orderBy("seq")
    heads = scored.select("day", "seq", "id", "headline", "high_prob",
                          F.row_number().over(order).alias("_k")).filter(F.col("_k") <= first)
    weighed = heads.withColumn("impact_score", rules.impact_score(rules.event_type(F.col("headline")))) \
        .withColumn("rank_score", F.col("high_prob") + 0.05 * F.col("impact_score"))
    best = Window.partitionBy("day").orderBy(F.col("rank_score").desc(), "seq")
    return (weighed.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= n)
            .select("day", "position", "id", "high_prob", "impact_score",
                    F.round("rank_score", 4).alias("rank_score")))
