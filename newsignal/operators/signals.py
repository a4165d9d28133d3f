"""Scored articles to one signal per commodity and day; feed health and ensemble weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.config import lookup
from newsignal.functions import rules, trading
from newsignal.functions.text import is_blank
from newsignal.session import checkpointed

ALL = "*"


# --- feed ---------------------------------------------------------------------------------------


def feed_health(articles: DataFrame, today) -> DataFrame:
    day = F.lit(today).cast("date")
    sums = articles.agg(F.count_if(F.to_date("published_at") == day).alias("n_today"),
                        F.max("published_at").alias("latest"))
    n = F.col("n_today")
    return sums.withColumn("status", F.when(n == 0, "CRITICAL").when(n < fv.MIN_ARTICLES, "ERROR")
                           .when(n < fv.WARN_ARTICLES, "WARNING").otherwise("OK"))


def dates_needing_signals(articles: DataFrame, predictions: DataFrame, first, last,
                          min_articles: int = fv.MIN_ARTICLES) -> DataFrame:
    """Days of a range with enough articles and no prediction yet."""
    day = F.to_date("published_at")
    counted = (articles.filter(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))
               .groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n_articles"))
               .filter(F.col("n_articles") >= min_articles))
    return counted.join(predictions.select(F.col("prediction_date").alias("day")), "day", "left_anti")


def recent_article_count(articles: DataFrame, today, days: int = 7,
                         min_articles: int = fv.MIN_ARTICLES) -> DataFrame:
    """Count of the newest day with enough articles within a week, else that of yesterday."""
    end = F.lit(today).cast("date")
    day = F.to_date("published_at")
    counts = articles.filter(day.between(F.date_sub(end, days), end)).groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"))
    enough = F.when(F.col("n") >= min_articles, F.col("day"))
    picked = counts.agg(F.max(enough).alias("day"), F.max_by("n", enough).alias("_n"),
                        F.max(F.when(F.col("day") == F.date_sub(end, 1), F.col("n"))).alias("_yesterday"))
    return picked.select("day", F.coalesce(F.when(F.col("day").isNotNull(), F.col("_n")), "_yesterday",
                                           F.lit(0)).alias("n_articles"))


def fallback_articles(articles: DataFrame, today, rich_days: int = 13, any_days: int = 7,
                      min_rich: int = 2, min_any: int = 5, rich_limit: int = 30,
                      any_limit: int = 50) -> DataFrame:
    """Articles of the newest usable day: first a day with rich bodies, else a day with enough articles.

    The list is a top-k report (richest bodies, else newest first), as on the dashboard.
    """
    end, day = F.lit(today).cast("date"), F.to_date("published_at")
    rich = F.length(F.coalesce("body_text", F.lit(""))) > fv.REAL_NEWS_BODY_CHARS
    recent = articles.withColumn("day", day).filter(
        F.col("day").between(F.date_sub(end, max(rich_days, any_days)), end))
    counts = recent.groupBy("day").agg(F.count_if(rich).alias("n_rich"), F.count(F.lit(1)).alias("n"))
    rich_day = F.max(F.when((F.col("n_rich") >= min_rich)
                            & (F.col("day") >= F.date_sub(end, rich_days)), F.col("day")))
    any_day = F.max(F.when((F.col("n") >= min_any)
                           & (F.col("day") >= F.date_sub(end, any_days)), F.col("day")))
    chosen = counts.agg(rich_day.alias("_rich"), any_day.alias("_any")).select(
        F.coalesce("_rich", "_any").alias("day"), F.col("_rich").isNotNull().alias("by_body"))
    of_day = recent.join(F.broadcast(chosen), "day").filter(~F.col("by_body") | rich)
    listed = of_day.orderBy(
        F.when(F.col("by_body"), F.length("body_text")).desc_nulls_last(), F.col("published_at").desc(),
        "id").limit(max(rich_limit, any_limit))
    position = Window.partitionBy("day").orderBy(
        F.when(F.col("by_body"), F.length("body_text")).desc_nulls_last(), F.col("published_at").desc(), "id")
    limit = F.when(F.col("by_body"), rich_limit).otherwise(any_limit)
    return (listed.withColumn("_k", F.row_number().over(position)).filter(F.col("_k") <= limit)
            .filter(~is_blank(F.col("headline"))).drop("_k"))


# --- ensemble -----------------------------------------------------------------------------------


def ensemble_weights(predictions: DataFrame, min_rows: int = fv.MIN_WEIGHT_ROWS) -> DataFrame:
    """Historical hit rate per commodity group, for commodities with enough decided rows.

    When several names of one group qualify, the name that sorts last wins.
    """
    group = lookup({row[0]: row[9] for row in fv.COMMODITIES}, F.col("commodity"))
    decided = predictions.filter(F.col("outcome").isin("correct", "incorrect")).groupBy("commodity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "correct").alias("n_correct"))
    rated = decided.filter(F.col("n") >= min_rows).select(
        group.alias("model"), "commodity", F.round(F.col("n_correct") / F.col("n"), 3).alias("weight"))
    return rated.filter("model is not null").groupBy("model").agg(
        F.max_by("weight", "commodity").alias("weight"))


def ensemble(scores: DataFrame, weights: DataFrame, embedding_model: str = "embedding",
             classes: Sequence[str] = ("HIGH", "LOW", "MEDIUM"), articles: DataFrame | None = None) -> DataFrame:
    """Weighted mean of class probabilities over all models of an article.

    The general model counts 1, a commodity model its hit rate (or 1), the embedding model 1.5. A
    class that a model does not know counts as 0 for it. The label is the most probable class, the
    first in class order on a tie. With ``articles`` (a frame with ``id``) every article gets a row; without
    any score it has the default probabilities.
    """
    weight = F.when(F.col("model") == embedding_model, fv.EMBEDDING_MODEL_WEIGHT).otherwise(
        F.coalesce("weight", F.lit(1.0)))
    weighted = scores.join(weights, "model", "left").withColumn("w", weight)
    per_model = weighted.groupBy("article_id", "model").agg(
        F.max("w").alias("w"),
        *[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("p"))), F.lit(0.0)).alias(c) for c in classes])
    mixed = per_model.groupBy("article_id").agg(*[
        (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"{c.lower()}_prob") for c in classes])
    if articles is not None:
        mixed = articles.select(F.col("id").alias("article_id")).join(mixed, "article_id", "left").fillna(
            {f"{c.lower()}_prob": fv.EMPTY_ENSEMBLE.get(c, 0.0) for c in classes})
    best = F.array_max(F.array(*[
        F.struct(F.col(f"{c.lower()}_prob").alias("p"), F.lit(-n).alias("rank"), F.lit(c).alias("label"))
        for n, c in enumerate(classes)]))
    return mixed.withColumn("_best", best).withColumns(
        {"label": F.col("_best.label"), "score": F.col("_best.p")}).drop("_best")


# --- signals ------------------------------------------------------------------------------------


def majority_vote(votes: DataFrame, keys: Sequence[str], vote: str, seq: str) -> DataFrame:
    """Most frequent non-NULL vote per key; among equals the one that was cast first."""
    counts = votes.filter(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(
        F.count(F.lit(1)).alias("n_votes"), F.min(seq).alias("_first"))
    best = F.max_by(F.col(vote), F.struct("n_votes", -F.col("_first")))
    return counts.groupBy(*keys).agg(best.alias(vote), F.max("n_votes").alias("n_votes"))


def _pool(scored: DataFrame, keywords: rules.Rules) -> DataFrame:
    """Articles once per commodity they mention and once for the whole day (key ``*``)."""
    title = F.col("_lower")
    with_flags = scored.withColumn("_lower", rules.lowered(F.col("headline"))).select(
        "day", "seq", "high_prob", trading_vote().alias("vote"),
        rules.keyword_hits(title, fv.BULL_WORDS).alias("bull"),
        rules.keyword_hits(title, fv.BEAR_WORDS).alias("bear"),
        rules.quick_event(title).isin(*rules.QUICK_SUPPLY_EVENTS).cast("int").alias("supply"),
        F.concat(F.array(F.lit(ALL)), rules.matched_groups(title, keywords)).alias("_keys"))
    # the array is never empty; the outer form keeps Spark from inferring a filter on its size, which
    # would match the keywords a second time below this projection
    return with_flags.withColumn("key", F.explode_outer("_keys")).drop("_keys")


def trading_vote() -> Column:
    return F.when(F.col("direction_vote").isNotNull(), trading.direction(F.col("direction_vote")))


def _votes() -> list[Column]:
    """Counts and first voters of the three directions; three values, so plain aggregates do."""
    out = []
    for side in ("bullish", "bearish", "neutral"):
        mine = F.col("vote") == side
        out += [F.count_if(mine).alias(f"n_{side}"), F.min(F.when(mine, F.col("seq"))).alias(f"first_{side}")]
    return out


def _winner() -> Column:
    ballots = F.array(*[
        F.struct(F.col(f"n_{s}").alias("n"), (-F.col(f"first_{s}")).alias("first"), F.lit(s).alias("side"))
        for s in ("bullish", "bearish", "neutral")])
    best = F.array_max(F.filter(ballots, lambda b: b["n"] > 0))
    return best["side"]


def pool_summaries(scored: DataFrame, keywords: rules.Rules, top: int = 5) -> DataFrame:
    """Per day and commodity (and per day as a whole): sizes, means, word sums, votes, top article.

    Everything but the top-5 mean is a plain aggregate of numbers with partial sums per task; the
    top-5 rows of a group are limited per task before they are shuffled. Articles are named by their
    number; headlines are looked up afterwards for the few that are shown.
    """
    pool = _pool(scored, keywords)
    sums = pool.groupBy("day", "key").agg(
        F.count(F.lit(1)).alias("n"), F.avg("high_prob").alias("mean_prob"), F.sum("bull").alias("bull"),
        F.sum("bear").alias("bear"), F.sum("supply").alias("supply"), F.min("seq").alias("first_seq"),
        *_votes())
    order = Window.partitionBy("day", "key").orderBy(F.col("high_prob").desc(), "seq")
    best = (pool.select("day", "key", "seq", "high_prob", F.row_number().over(order).alias("_k"))
            .filter(F.col("_k") <= top).groupBy("day", "key").agg(
                F.avg("high_prob").alias("top_prob"),
                F.max(F.when(F.col("_k") == 1, F.col("seq"))).alias("top_seq")))
    return sums.join(best, ["day", "key"])


def _per_commodity(scored: DataFrame, keywords: rules.Rules, days: DataFrame | None) -> DataFrame:
    """One row per day and commodity with its own pool, or the pool of the day if it has none."""
    summaries = pool_summaries(scored, keywords)
    fields = [c for c in summaries.columns if c not in ("day", "key")]
    # one short map per day: the pool of every commodity and of the whole day
    pools = summaries.groupBy("day").agg(F.map_from_entries(F.collect_list(
        F.struct("key", F.struct(*fields)))).alias("_pools"))
    if days is not None:
        pools = days.select("day").distinct().join(pools, "day", "left")
    own, whole = F.element_at("_pools", F.col("commodity")), F.element_at("_pools", F.lit(ALL))
    grid = pools.withColumn("commodity", F.explode(F.array(*[F.lit(name) for name, _ in keywords])))
    rows = grid.withColumns({
        "n_relevant": F.coalesce(own["n"], F.lit(0)), "n_articles": F.coalesce(whole["n"], F.lit(0)),
        "_p": F.coalesce(own, whole)}).select(
        "day", "commodity", "n_relevant", "n_articles", *[F.col(f"_p.{f}").alias(f) for f in fields])
    # few rows that are needed three times below: without the cut every use would score the text again
    rows = checkpointed(rows)
    wanted = rows.select(F.explode(F.array("top_seq", "first_seq")).alias("seq")).distinct()
    shown = scored.select("seq", "headline").join(wanted, "seq", "left_semi")
    for name in ("top", "first"):
        rows = rows.join(shown.select(F.col("seq").alias(f"{name}_seq"),
                                      F.col("headline").alias(f"{name}_headline")), f"{name}_seq", "left")
    return rows


def _with_event(rows: DataFrame) -> DataFrame:
    """Event of the strongest article; the shown headline is the first of the day without a match."""
    event = rules.event_type(F.col("top_headline"))
    return rows.withColumn("event_type", F.when(F.col("n").isNull(), "other").otherwise(event)).withColumn(
        "impact_score", rules.impact_score(F.col("event_type")))


def live_signals(scored: DataFrame, keywords: rules.Rules = fv.SIGNAL_KEYWORDS,
                 days: DataFrame | None = None) -> DataFrame:
    """Live signal of every commodity and day.

    ``scored``: day, id, seq (order of arrival), headline, high_prob, direction_vote. A day of
    ``days`` without articles yields the fixed LOW row.
    """
    rows = _with_event(_per_commodity(scored, keywords, days))
    empty = F.col("n").isNull()
    bull = F.col("bull") + 2 * F.col("supply")
    by_words = F.when(bull > F.col("bear") * 1.3, "bullish").when(
        F.col("bear") > bull * 1.3, "bearish").otherwise("neutral")
    label = F.when(empty, "LOW").otherwise(trading.magnitude_label(F.col("top_prob")))
    rows = rows.withColumns({
        "signal": label, "direction": F.when(empty, "neutral").otherwise(F.coalesce(_winner(), by_words)),
        "scaled_conf": F.when(empty, 35.0).otherwise(trading.live_confidence(F.col("top_prob")))})
    return rows.select(
        "day", "commodity", "signal", "direction",
        F.when(empty, "Weak").otherwise(trading.strength(F.col("direction"), F.col("scaled_conf")))
        .alias("strength"),
        F.when(empty, "Hold").otherwise(trading.bias(F.col("direction"), F.col("scaled_conf"))).alias("bias"),
        "scaled_conf", trading.move_bucket(F.col("signal")).alias("expected_move"), "n_relevant",
        "n_articles", F.col("top_prob").alias("high_prob"),
        F.when(empty, "").when(F.col("n_relevant") > 0, F.col("top_headline"))
        .otherwise(F.col("first_headline")).alias("top_headline"),
        "event_type", "impact_score")


def history_signals(scored: DataFrame, keywords: rules.Rules = fv.SIGNAL_KEYWORDS,
                    min_articles: int = fv.MIN_ARTICLES) -> DataFrame:
    """Backfilled signal of every commodity and day: mean over the whole pool, votes only."""
    rows = _with_event(_per_commodity(scored, keywords, None)).filter(F.col("n_articles") >= min_articles)
    rows = rows.withColumns({"signal": trading.magnitude_label(F.col("mean_prob")),
                             "direction": F.coalesce(_winner(), F.lit("neutral"))})
    return rows.select(
        "day", "commodity", "signal", "direction", F.col("mean_prob").alias("high_prob"),
        trading.history_confidence(F.col("mean_prob"), F.col("signal"), F.col("direction"),
                                   F.col("n_relevant")).alias("scaled_conf"),
        trading.move_bucket(F.col("signal")).alias("expected_move"), "n_relevant", "n_articles",
        "top_headline", "event_type", "impact_score")


def as_prediction_input(signals: DataFrame) -> DataFrame:
    """Signals in the shape that ``trades.assemble_predictions`` takes."""
    return signals.select(
        F.xxhash64("day", "commodity").alias("id"), F.col("day").alias("prediction_date"), "commodity",
        "signal", "direction", "high_prob", F.lit(None).cast("double").alias("confidence"), "scaled_conf",
        "expected_move", F.substring("top_headline", 1, 200).alias("headline"), "event_type",
        "impact_score", F.col("n_articles").alias("article_count"))


def signal_view(signals: DataFrame) -> DataFrame:
    """Display columns of a signal: bands, muted flag, label and invalidation text."""
    conf, n = F.col("scaled_conf"), F.col("n_relevant")
    muted = conf < 50
    directional = F.col("direction") != "neutral"
    stop = lookup({row[0]: row[8] for row in fv.COMMODITIES}, F.col("commodity"), fv.DEFAULT_STOP_PCT)
    sign = F.when(F.col("direction") == "bullish", "+").when(F.col("direction") == "bearish", "-")
    return signals.select(
        "day", "commodity",
        F.when(conf >= 70, "High").when(conf >= 50, "Medium").otherwise("Low — monitor only")
        .alias("confidence_band"),
        F.when(n >= 15, "good").when(n >= 5, "thin").otherwise("unreliable").alias("article_band"),
        muted.alias("muted"),
        F.when(~directional, "Neutral").when(muted, F.concat(F.initcap("direction"), F.lit(" Lean")))
        .otherwise(F.initcap("direction")).alias("direction_label"),
        F.when(directional, F.concat(sign, "expected_move")).otherwise("<1%").alias("move_label"),
        F.when((F.col("signal") == "HIGH") & directional & ~muted,
               F.concat(F.lit("price moves >"), stop.cast("string"), F.lit("% against position")))
        .alias("invalidation"))
