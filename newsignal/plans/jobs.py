"""The jobs of the desk: compositions of the operators, table in and table out.

Tables live in one folder, one Parquet table per name. A job reads what it needs, writes its result
keyed, and can be repeated.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from newsignal import fixed_values as fv
from newsignal import schemas
from newsignal.operators import entities, labels, metrics, models, prices, signals, trades
from newsignal.functions import rules
from newsignal.functions.text import is_blank
from newsignal.operators.keyed import drop_blank_keys, merge_nonempty, one_per_key
from newsignal.operators.listings import body_counts
from newsignal.plans import ledger
from newsignal.session import checkpointed
from newsignal.sources import changes, sinks

MONTH = "month"


@dataclass
class Desk:
    """Folder of tables with their schemas."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        """A table conformed to its schema; empty if it was not written yet."""
        schema = getattr(schemas, name.upper(), None)
        try:
            df = self.spark.read.parquet(self.path(name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return schemas.conform(df, schema, schemas.DEFAULTS.get(name)) if schema else df

    def upsert(self, name: str, batch: DataFrame, keys: list[str], partition: str) -> None:
        sinks.upsert_partitions(batch, self.path(name), keys, [F.lit(1)], partition)


def ingest_articles(desk: Desk, batch: DataFrame) -> None:
    """New articles by id; stored ones stay as they are. The table is partitioned by publication month."""
    rows = schemas.conform(batch, schemas.ARTICLES).withColumn(MONTH, _published_month())
    sinks.append_absent(rows, desk.path("articles"), ["id"], [F.col("fetched_at")], MONTH)


def refill_articles(desk: Desk, batch: DataFrame) -> None:
    """Stored articles whose title, headline or body is empty take those of the batch, by id.

    Only the months with a changed article are rewritten.
    """
    stored = desk.read("articles")
    lacking = stored.filter(is_blank(F.col("body_text")) | is_blank(F.col("headline")) | is_blank(F.col("title")))
    wanted = schemas.conform(batch, schemas.ARTICLES).join(lacking.select("id"), "id", "left_semi")  # only their texts are shuffled
    update = one_per_key(wanted, ["id"], [F.col("fetched_at").desc()])
    columns = ["title", "headline", "body_text"]
    offered = update.join(lacking.select("id", *[F.col(c).alias(f"_{c}") for c in columns]), "id").select(
        "id", *[F.when(is_blank(F.col(f"_{c}")), F.col(c)).alias(c) for c in columns])
    merged = merge_nonempty(lacking, offered, "id", columns, ["body_text", "headline", "title"]).filter("changed").drop("changed")
    rows = schemas.conform(merged, schemas.ARTICLES).withColumn(MONTH, _published_month())
    desk.upsert("articles", checkpointed(rows), ["id", MONTH], MONTH)


def _published_month():
    return F.coalesce(F.date_format("published_at", "yyyy-MM"), F.lit("none"))


def price_job(desk: Desk) -> DataFrame:
    """Report bodies to daily prices, changes filled, upserted by date and symbol; returns the summary."""
    rows = prices.latest_per_day(prices.price_rows(desk.read("articles")))
    batch = drop_blank_keys(prices.fill_change(rows), "symbol").select(
        "date", "symbol", "price", "pct_change_24h")
    desk.upsert("prices", checkpointed(batch), ["date", "symbol"], "symbol")  # the upsert reads it twice; reports are parsed once
    return prices.symbol_summary(desk.read("prices"))


def label_job(desk: Desk, fixed_thresholds: bool = False, route: bool = True) -> DataFrame:
    """Label articles by next-day moves, upserted by id; returns the label shares.

    The table is partitioned by publication month, which an article keeps, so a run rewrites only the
    months it labels.
    """
    labelled = labels.label_articles(desk.read("articles"), desk.read("prices"),
                                     fixed_thresholds=fixed_thresholds, route=route)
    batch = schemas.conform(labelled, schemas.LABELLED_ARTICLES).withColumn(
        MONTH, trades.month_of("published_at"))
    desk.upsert("labelled_articles", batch, ["id", MONTH], MONTH)
    return labels.label_distribution(desk.read("labelled_articles"))


def entity_job(desk: Desk, lexicon: DataFrame | None = None, now=None) -> int:
    """Entities of labelled articles that have none yet; returns how many were added."""
    todo = entities.unprocessed(desk.read("labelled_articles"), desk.read("entities"))
    rows = entities.extract_entities(todo, lexicon).withColumn(
        "extracted_at", F.lit(now).cast("timestamp") if now else F.current_timestamp())
    before = desk.read("entities").count()
    sinks.append_absent(schemas.conform(rows, schemas.ENTITIES), desk.path("entities"), ["article_id"],
                        [F.col("article_id")])
    return desk.read("entities").count() - before


def signal_job(desk: Desk, scored: DataFrame, market: DataFrame, first, last,
               keywords=fv.SIGNAL_KEYWORDS) -> int:
    """Signals for days with enough articles and no prediction; returns how many were logged.

    ``scored``: day, id, seq, headline, high_prob, direction_vote.
    """
    stored = desk.read("predictions")
    todo = signals.dates_needing_signals(desk.read("articles"), stored, first, last)
    rows = signals.history_signals(scored.join(todo.select("day"), "day", "left_semi"), keywords)
    logged = trades.assemble_predictions(
        signals.as_prediction_input(rows), desk.read("prices"), market, stored)
    batch = schemas.conform(logged, schemas.PREDICTIONS, schemas.DEFAULTS["predictions"]).withColumn(
        MONTH, trades.month_of())
    before = stored.count()
    sinks.append_absent(batch, desk.path("predictions"), ["prediction_date", "commodity", MONTH], [F.col("id")], MONTH)
    return desk.read("predictions").count() - before


SETTLEMENT_REACH = max(fv.CLOSE_TIER1_DAYS, fv.CLOSE_TIER2_DAYS, fv.NEXT_CLOSE_DAYS)


def _months_to_settle(desk: Desk, stored: DataFrame, references: dict[str, DataFrame], today, mark: str) -> list | None:
    """Months whose rows may settle otherwise than in the last run; None stands for all of them.

    A row looks at the prices of its day and of the ``SETTLEMENT_REACH`` days after it, and a trade at the rows of its
    month. So a month is due if its files are others than the last run left, if a price in the reach of one of its days
    has changed, or if days of it have become old enough since. There are as many months as the calendar has.
    """
    seen = changes.last_day(desk.spark, mark)
    days = [changes.changed_days(df, mark, name) for name, df in references.items()]
    if seen is None or any(d is None for d in days):
        return None
    reached = days[0].unionByName(days[1]).distinct().select(
        F.explode(F.sequence(F.date_sub("day", SETTLEMENT_REACH), F.col("day"))).alias("day"))
    span = [F.lit(d).cast("date") for d in (seen, today)]  # a repeated or earlier day adds no more than its own month
    aged = desk.spark.range(1).select(F.explode(F.sequence(
        F.date_sub(F.least(*span), 1), F.date_sub(F.greatest(*span), 1))).alias("day"))
    due = reached.unionByName(aged).select(trades.month_of("day").alias("part")).unionByName(
        changes.changed_partitions(stored, MONTH, mark)).distinct()
    return [row["part"] for row in due.collect()]


def settlement_job(desk: Desk, market: DataFrame, today, full: bool = False) -> DataFrame:
    """Backfill actuals and recompute trades of the months that are due; rewrites only months whose rows changed.

    ``full`` looks at every month, as the first run does.
    """
    mark = desk.path("settlement_mark")
    table = desk.read("predictions")
    prices_ = checkpointed(desk.read("prices").select("date", "symbol", "price"))
    market = checkpointed(market.select("date", "ticker", "price"))
    references = {"prices": prices_, "market": market}
    on_disk = sinks.exists(desk.spark, desk.path("predictions"))
    due = None if full or not on_disk else _months_to_settle(desk, desk.spark.read.parquet(desk.path("predictions")), references, today, mark)
    if due is not None:
        known = F.col(MONTH).isin([month for month in due if month is not None])
        table = table.filter(known | F.col(MONTH).isNull() if None in due else known)
    stored = table.drop(MONTH)
    if due is None or due:
        settled = trades.recompute_trades(trades.settle(stored, prices_, market, today))
        batch = schemas.conform(settled, schemas.PREDICTIONS).withColumn(MONTH, trades.month_of())
        changed = batch.join(
            batch.drop(MONTH).exceptAll(stored.select(*schemas.PREDICTIONS.fieldNames()))
            .select(trades.month_of().alias(MONTH)).distinct(), MONTH, "left_semi")
        changed = checkpointed(changed)
        if changed.head(1):
            desk.upsert("predictions", changed, ["prediction_date", "commodity", MONTH], MONTH)
    if on_disk:
        changes.set_mark(mark, desk.spark.read.parquet(desk.path("predictions")), MONTH, today, references)
    return metrics.trading_metrics(desk.read("predictions"))


def _resumable(desk: Desk, run: str | None, *inputs: DataFrame, parameters=()) -> ledger.Ledger:
    """The ledger of a named run; a run without a name is one of its own and is never resumed."""
    version = ledger.input_version(*inputs, parameters=parameters) if run else "-"
    return ledger.Ledger(desk.spark, desk.path("runs"), run or uuid.uuid4().hex, version)


def daily_job(desk: Desk, batch: DataFrame, market: DataFrame, today, run: str | None = None, until: str | None = None) -> str:
    """Ingest, then label, extract and settle, unless the feed of the day is unhealthy.

    Repeated under the same ``run`` with the same inputs, it goes on at the first step that has not finished;
    ``until`` ends it after that step.
    """
    return _resumable(desk, run, batch, market, parameters=["daily", today]).steps([
        ("ingest", lambda: ingest_articles(desk, batch)),
        ("feed", lambda: signals.feed_health(desk.read("articles"), today).first()["status"]),
        ("label", lambda: label_job(desk)),
        ("entities", lambda: entity_job(desk)),
        ("settle", lambda: settlement_job(desk, market, today))],
        stop=lambda step, status: step == until or step == "feed" and status in ("CRITICAL", "ERROR"))


def catch_up_job(desk: Desk, batches: list[DataFrame], run: str | None = None) -> int:
    """Ingest all waiting batches and fill the empty bodies that they bring, then price and label.

    Returns the number of articles with a body. ``run`` as for :func:`daily_job`.
    """
    steps = []
    for n, batch in enumerate(batches):
        steps += [(f"ingest {n}", lambda batch=batch: ingest_articles(desk, batch)), (f"refill {n}", lambda batch=batch: refill_articles(desk, batch))]
    _resumable(desk, run, *batches, parameters=["catch-up"]).steps(
        [*steps, ("prices", lambda: price_job(desk)), ("labels", lambda: label_job(desk))])
    return body_counts(desk.read("articles")).first()["n_filled"]


SCORING_MODELS = ("general", "embedding")


def score_job(desk: Desk, first, last, vectors: DataFrame | None = None, groups=fv.GROUP_KEYWORDS) -> DataFrame:
    """Articles of the days from ``first`` to ``last``, scored by the stored models.

    day, id, seq, headline, label, score, high_prob, medium_prob, low_prob, direction_vote (of the stored direction
    model, null without one), quick entities and the template explanation. ``vectors`` (id, embedding) are needed if an
    embedding model is stored. Articles without usable text get the default probabilities.
    """
    day = F.to_date("published_at")
    wanted = desk.read("articles").filter(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    asked = wanted.select("id", "headline", "body_text", day.alias("aligned_date"), F.lit(None).cast("string").alias("label"),
                          F.lit(None).cast("double").alias("price_change"))
    daily = prices.daily_features(desk.read("prices"), desk.read("articles"))
    rows = models.training_set(asked, daily, groups=groups)
    if vectors is not None:
        rows = models.with_embedding(rows, vectors)
    rows = checkpointed(rows)
    stored = {name: models.load_model(desk.spark, desk.path(f"models/{name}")) for name in [*SCORING_MODELS, *[g for g, _ in groups]]
              if sinks.exists(desk.spark, desk.path(f"models/{name}")) and (name != "embedding" or vectors is not None)}
    if not stored:
        raise ValueError("no stored model; run the training job first")
    scores = checkpointed(models.long_scores(stored, rows))
    mixed = signals.ensemble(scores, signals.ensemble_weights(desk.read("predictions")), articles=asked)
    out = mixed.withColumnRenamed("article_id", "id").join(wanted.select("id", "headline", day.alias("day")), "id")
    if sinks.exists(desk.spark, desk.path("models/direction")):
        moved = models.load_model(desk.spark, desk.path("models/direction")).score(rows).select(
            "id", F.when(F.col("prediction") == "rise", "bullish").when(F.col("prediction") == "fall", "bearish").otherwise("neutral").alias("direction_vote"))
        out = out.join(moved, "id", "left")
    else:
        out = out.withColumn("direction_vote", F.lit(None).cast("string"))
    out = out.withColumn("q", rules.quick_entities(F.col("headline")))
    return out.select("day", "id", F.xxhash64("id").alias("seq"), "headline", "label", "score", "high_prob", "medium_prob", "low_prob",
                      "direction_vote", "q.event_type", "q.region", "q.sentiment", "q.supply_impact",
                      entities.explanation(F.col("label"), F.col("score"), F.col("q")).alias("explanation"))


def backfill_job(desk: Desk, market: DataFrame, first, last, vectors: DataFrame | None = None, keywords=fv.SIGNAL_KEYWORDS,
                 groups=fv.GROUP_KEYWORDS) -> int:
    """Score the articles of a span with the stored models and log the signals of its days; returns how many."""
    return signal_job(desk, checkpointed(score_job(desk, first, last, vectors, groups)), market, first, last, keywords)


def full_training_job(desk: Desk, vectors: DataFrame | None = None, groups=fv.GROUP_KEYWORDS, logistic: dict | None = None,
                      trees: dict | None = None, embedding: dict | None = None) -> DataFrame:
    """All models of the desk: general, boosted trees, direction, one for each group with enough rows and, with
    ``vectors`` (id, embedding), embedding trees. Each kind is validated, fitted on everything and stored.

    ``logistic``, ``trees`` and ``embedding`` change the settings of the fits; by default they are the published final ones.
    """
    daily = prices.daily_features(desk.read("prices"), desk.read("articles"))
    labelled = desk.read("labelled_articles")
    numeric, logistic = fv.NUMERIC_FEATURES, logistic or {}
    given = trees or {}
    trees, embedding = {**fv.FINAL_TREES, **given}, {**fv.EMBEDDING_TREES, **(embedding or {})}
    rows = checkpointed(models.training_set(labelled, daily, groups=groups))
    if rows.count() < fv.MIN_SAMPLES:
        raise ValueError(f"at least {fv.MIN_SAMPLES} labelled articles are needed")
    moves = checkpointed(models.training_set(labelled, daily, "direction", groups=groups))
    validated = [("logistic", "magnitude", rows, logistic), ("trees", "magnitude", rows, trees), ("logistic", "direction", moves, logistic)]
    for kind, label_type, part, settings in validated:
        how = {**fv.VALIDATION_TREES, **given} if kind == "trees" else settings
        folds = models.walk_forward(part, kind, label_type, numeric=numeric, **how)
        models.save_metrics(schemas.conform(folds, schemas.MODEL_METRICS), desk.path("model_metrics"))
    fitted = {"general": models.fit_text_model(rows, numeric=numeric, **logistic),
              "trees": models.fit_text_model(rows, "trees", numeric, **trees),
              "direction": models.fit_text_model(moves, numeric=numeric, **logistic),
              **models.group_models(rows, [name for name, _ in groups], numeric=numeric, **logistic)}
    if vectors is not None:
        fitted["embedding"] = models.fit_text_model(models.with_embedding(rows, vectors), "trees", numeric, "embedding",
                                                    fv.EMBEDDING_MAX_FEATURES, fv.EMBEDDING_TOP_TERMS, **embedding)
    for name, model in fitted.items():
        models.save_model(model, desk.path(f"models/{name}"))
    return metrics.model_view(desk.read("model_metrics"))


def training_job(desk: Desk, label_type: str = "magnitude", **settings) -> DataFrame:
    """Validate, fit on everything, save the model and append its fold metrics; returns the view."""
    daily = prices.daily_features(desk.read("prices"), desk.read("articles"))
    rows = models.training_set(desk.read("labelled_articles"), daily, label_type).persist()
    try:
        if rows.count() < fv.MIN_SAMPLES:
            raise ValueError(f"at least {fv.MIN_SAMPLES} labelled articles are needed")
        folds = models.walk_forward(rows, label_type=label_type, numeric=fv.NUMERIC_FEATURES, **settings)
        models.save_metrics(schemas.conform(folds, schemas.MODEL_METRICS), desk.path("model_metrics"))
        fitted = models.fit_text_model(rows, numeric=fv.NUMERIC_FEATURES, **settings)
        models.save_model(fitted, desk.path(f"models/{label_type}"))
    finally:
        rows.unpersist()
    return metrics.model_view(desk.read("model_metrics"))
