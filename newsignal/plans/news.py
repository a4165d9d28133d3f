"""Registered queries: feed, entities, signals, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.config import with_commodity_config
from newsignal.functions import rules, text, trading
from newsignal.operators import entities, labels, listings, signals, trades
from newsignal.plans.series import _labelled
from newsignal.sources import adapters
from newsignal.sources.tables import read_table

FEED_END = "1995-03-01"


def feed_health(spark, folder):
    return signals.feed_health(adapters.feed(spark, folder), FEED_END)


def dates_needing_signals(spark, folder):
    predicted = adapters.predictions(spark, folder).filter("trade_status = 'TRADE'")
    return signals.dates_needing_signals(adapters.feed(spark, folder), predicted, "1995-01-05", "1995-02-20")


def recent_article_count(spark, folder):
    return signals.recent_article_count(adapters.feed(spark, folder), "1995-03-04")


def fallback_articles(spark, folder):
    return signals.fallback_articles(adapters.feed(spark, folder), "1995-03-04").select("id", "day", "by_body")


def ensemble_weights(spark, folder):
    return signals.ensemble_weights(adapters.settled_predictions(spark, folder))


def _ensemble(spark, folder):
    return signals.ensemble(adapters.scores(spark, folder), ensemble_weights(spark, folder))


def ensemble_scores(spark, folder):
    return _ensemble(spark, folder).select(
        "article_id", "label", F.round("score", 6).alias("score"),
        *[F.round(c, 6).alias(c) for c in ("high_prob", "medium_prob", "low_prob")])


def batch_scoring(spark, folder):
    """Ensemble result with quick entities and the template explanation, for days with enough articles."""
    feed = adapters.feed(spark, folder)
    enough = feed.groupBy("published_at").agg(F.count(F.lit(1)).alias("n_day")).filter("n_day >= 5")
    rows = feed.join(enough, "published_at", "left_semi").join(
        _ensemble(spark, folder).withColumnRenamed("article_id", "id"), "id")
    quick = rules.quick_entities(F.col("headline"))
    rows = rows.withColumn("q", quick)
    return rows.select(
        "id", "label", F.round("score", 6).alias("score"), "q.event_type", "q.region", "q.sentiment",
        "q.supply_impact",
        entities.explanation(F.col("label"), F.col("score"), F.col("q")).alias("explanation"))


def direction_votes(spark, folder):
    return signals.majority_vote(adapters.scored_articles(spark, folder), ["day"], "direction_vote", "seq")


def _live(spark, folder):
    days = adapters.prices(spark, folder).select(F.col("date").alias("day")).distinct()
    return signals.live_signals(adapters.scored_articles(spark, folder), adapters.DESK_KEYWORDS, days)


def live_signals(spark, folder):
    return _live(spark, folder).withColumn("high_prob", F.round("high_prob", 6))


def live_signals_energy(spark, folder):
    """The same with the package's own commodity keywords."""
    out = signals.live_signals(adapters.scored_articles(spark, folder))
    return out.select("day", "commodity", "signal", "direction", "scaled_conf", "n_relevant", "event_type",
                      "impact_score")


def signal_view(spark, folder):
    return signals.signal_view(_live(spark, folder))


def _history(spark, folder):
    return signals.history_signals(adapters.scored_articles(spark, folder), adapters.DESK_KEYWORDS)


def history_signals(spark, folder):
    return _history(spark, folder).withColumns({
        "high_prob": F.round("high_prob", 6), "scaled_conf": F.round("scaled_conf", 4)})


def assembled_predictions(spark, folder):
    """Backfilled signals to prediction rows that are not stored yet."""
    stored = adapters.predictions(spark, folder).filter("trade_status = 'TRADE'")
    rows = trades.assemble_predictions(
        signals.as_prediction_input(_history(spark, folder)), adapters.prices(spark, folder),
        adapters.market_prices(spark, folder), stored)
    return rows.drop("id", "headline").withColumn("confidence", F.round("confidence", 6))


def scaled_confidence(spark, folder):
    p = F.col("high_prob")
    label = trading.magnitude_label(p)
    vote = F.coalesce("direction_vote", F.lit("neutral"))
    return adapters.scored_articles(spark, folder).select(
        "id", trading.live_confidence(p).alias("live_conf"),
        F.round(trading.history_confidence(p, label, vote, F.col("seq") % 20), 6).alias("history_conf"),
        label.alias("label"), trading.move_bucket(label).alias("expected_move"))


def key_articles(spark, folder):
    return listings.key_articles(adapters.scored_articles(spark, folder))


def context_panels(spark, folder):
    return listings.context_panels(_seq_articles(spark, folder))


def desk_panels(spark, folder):
    panels = [("first", ["tion", "eau"]), ("second", ["ing", "sch"]), ("third", ["ther"])]
    return listings.context_panels(_seq_articles(spark, folder), panels)


def _seq_articles(spark, folder):
    return adapters.feed(spark, folder).withColumn("seq", F.col("id").cast("bigint"))


def _lexicon(spark, folder):
    """A word list with made-up polarities, from the words of the benchmark texts."""
    words = read_table(spark, folder, "benchmark", ["text"]).select(
        F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    return words.withColumn("polarity", ((F.length("word") * 37) % 21 - 10).cast("double") / 10)


def article_entities(spark, folder):
    return entities.extract_entities(adapters.articles(spark, folder), _lexicon(spark, folder))


def lexicon_sentiment(spark, folder):
    """Sentiment over whole bodies."""
    return entities.lexicon_sentiment(adapters.articles(spark, folder), _lexicon(spark, folder), "body_text")


def quick_entities(spark, folder):
    return adapters.articles(spark, folder).select(
        "id", rules.quick_entities(F.col("body_text")).alias("q")).select("id", "q.*")


def word_balance(spark, folder):
    rows = entities.word_balance(adapters.articles(spark, folder).select("id", "body_text"), "body_text")
    return rows.drop("body_text")


def body_rules(spark, folder):
    """Event, region, group, supply flag and impact over whole bodies, where keywords do occur."""
    rows = adapters.articles(spark, folder).select("id", rules.lowered(F.col("body_text")).alias("body"))
    grouped = rows.withColumn("commodity_group", rules.max_count(
        F.col("body"), fv.GROUP_KEYWORDS, fv.GENERAL_GROUP))
    return rules.entity_frame(grouped, "body").drop("body")


def rule_table_routing(spark, folder):
    """First-match routing with a rule table that comes as data."""
    rows = [(n, word, symbol) for n, (symbol, words) in enumerate(adapters.DESK_ROUTING) for word in words]
    table = spark.createDataFrame(rows, "rule_order int, keyword string, value string")
    routed = rules.match_rule_table(
        adapters.articles(spark, folder), rules.routing_text(F.col("headline"), F.col("body_text")), table,
        "Dubai")
    return routed.select("id", "matched")


def article_routing(spark, folder):
    return adapters.articles(spark, folder).select(
        "id", rules.price_symbol(F.col("headline"), F.col("body_text"), adapters.DESK_ROUTING)
        .alias("desk_symbol"),
        rules.price_symbol(F.col("headline"), F.col("body_text")).alias("energy_symbol"))


def _entities_of_labelled_docs(spark, folder):
    """Entity rows exist for the documents of the labels table."""
    known = read_table(spark, folder, "labels", ["doc_id"]).select(F.col("doc_id").cast("string").alias("id")) \
        .distinct()
    return entities.extract_entities(adapters.articles(spark, folder).join(known, "id", "left_semi"))


def unprocessed_articles(spark, folder):
    return entities.unprocessed(_labelled(spark, folder), _entities_of_labelled_docs(spark, folder)).select("id")


def labelled_with_entities(spark, folder):
    return entities.with_entities(_labelled(spark, folder), _entities_of_labelled_docs(spark, folder)).select(
        "id", "aligned_date", "label", "event_type", "region", "supply_impact", "impact_score")


def bodies_by_id(spark, folder):
    """Bodies looked up for a list of ids."""
    wanted = read_table(spark, folder, "labels", ["doc_id"]).select(F.col("doc_id").cast("string").alias("id"))
    bodies = adapters.articles(spark, folder).select("id", F.length("body_text").alias("body_chars"))
    return wanted.join(bodies, "id", "left").select("id", F.coalesce("body_chars", F.lit(0)).alias("body_chars"))


def web_articles(spark, folder):
    return entities.web_articles(read_table(spark, folder, "pages", ["page_id", "url"]))


def feed_listing(spark, folder):
    return listings.feed_listing(_labelled(spark, folder)).select("id", "published_at", "label")


def report_listing(spark, folder):
    return listings.report_listing(adapters.articles(spark, folder), report_name="SRC5").select(
        "id", "published_at", "report_name", "content_id")


def noise_filtered(spark, folder):
    return labels.drop_noise_reports(adapters.articles(spark, folder), adapters.DESK_NOISE).groupBy(
        "report_name").agg(F.count(F.lit(1)).alias("n"))


def body_counts(spark, folder):
    return listings.body_counts(adapters.landed_articles(spark, folder))


def date_window(spark, folder):
    rows = adapters.landed_articles(spark, folder)
    return rows.filter(listings.in_window(F.col("published_at"), "1996-01-01", "1997-12-31")).select(
        "id", "published_at")


def uuid_ids(spark, folder):
    return adapters.landed_articles(spark, folder).select(
        rules.normal_id(F.col("id")).alias("id"), rules.is_uuid(F.col("id")).alias("is_uuid"))


def headline_filters(spark, folder):
    rows = adapters.articles(spark, folder)
    return rows.select("id", rules.is_generic_headline(F.col("headline")).alias("is_generic"),
                       rules.is_real_news(F.col("headline"), F.col("body_text")).alias("is_real_news"))


def quality_articles(spark, folder):
    return listings.quality_articles(adapters.feed(spark, folder), FEED_END).select("id", "published_at")


def empty_body_worklist(spark, folder):
    return listings.empty_body_worklist(adapters.landed_articles(spark, folder), ["tion", "EAU"]).select(
        "id", "published_at")


def commodity_lookup(spark, folder):
    rows = adapters.predictions(spark, folder).select("commodity").distinct()
    return with_commodity_config(rows)


QUERIES = {f.__name__: f for f in [
    feed_health, dates_needing_signals, recent_article_count, fallback_articles, ensemble_weights,
    ensemble_scores, batch_scoring, direction_votes, live_signals, live_signals_energy, signal_view,
    history_signals, assembled_predictions, scaled_confidence, key_articles, context_panels, desk_panels,
    article_entities, lexicon_sentiment, quick_entities, word_balance, body_rules, rule_table_routing,
    article_routing, unprocessed_articles, labelled_with_entities, bodies_by_id, web_articles, feed_listing,
    report_listing, noise_filtered, body_counts, date_window, uuid_ids, headline_filters, quality_articles,
    empty_body_worklist, commodity_lookup]}
