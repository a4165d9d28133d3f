"""Training sets, validation splits, classifiers and scoring on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.functions import rules, text
from newsignal.operators import features as feat
from newsignal.operators.keyed import union_distinct_by_id
from newsignal.operators.labels import direction_label
from newsignal.operators.metrics import class_report
from newsignal.operators.ordered import ordered_runs, row_numbers
from newsignal.operators.prices import add_numeric_features
from newsignal.session import checkpointed, forget

# --- training set and splits ----------------------------------------------------------------------


def usable_text(body: Column, headline: Column) -> Column:
    """Array with one (snippet, text) struct, or none when the article carries no signal.

    As an outer generator it is evaluated once per article. A filter over the computed text would be
    pushed below it and clean the body again for every use.
    """
    specific = ~rules.is_generic_headline(headline)
    made = text.let(text.training_snippet(body), lambda snippet: F.struct(
        snippet.alias("snippet"), text.training_text(snippet, headline).alias("text")))
    return F.filter(F.array(made), lambda t: (t["text"] != "") & (
        (F.length(t["snippet"]) > fv.TRAIN_SNIPPET_MIN_CHARS) | specific))


def is_usable(body: Column, headline: Column) -> Column:
    """Whether an article carries signal, for callers that do not need its text: :func:`usable_text` is not empty.

    With a headline that is specific and not blank it does, whatever the body, so the body is cleaned only for the others.
    """
    enough = F.coalesce((text.training_text(F.lit(""), headline) != "") & ~rules.is_generic_headline(headline), F.lit(False))
    return F.when(enough, True).otherwise(F.size(usable_text(body, headline)) > 0)


def training_set(labelled: DataFrame, daily: DataFrame, label_type: str = "magnitude",
                 min_body_chars: int = 0, groups: rules.Rules = fv.GROUP_KEYWORDS, texts: bool = True) -> DataFrame:
    """Labelled articles with signal: id, aligned_date, label, text, commodity group, numeric features.

    ``texts=False`` leaves the text out, and with it most of the cleaning.
    """
    rows = labelled.filter(F.col("aligned_date").isNotNull())
    if min_body_chars:
        rows = rows.filter(F.length(F.coalesce("body_text", F.lit(""))) >= min_body_chars)
    kept = ["id", "headline", "aligned_date", "label", "price_change"]
    if texts:
        rows = rows.select(*kept, F.inline_outer(usable_text(F.col("body_text"), F.col("headline")))).filter("text is not null")
    else:
        rows = rows.filter(is_usable(F.col("body_text"), F.col("headline"))).select(*kept)
    if label_type == "direction":
        rows = rows.withColumn("label", direction_label(F.col("price_change")))
    rows = rows.withColumn("commodity_group", rules.commodity_group(F.col("headline"), groups))
    return add_numeric_features(
        rows.select("id", "aligned_date", "label", *(["text"] if texts else []), "commodity_group"), daily)


def fold_bounds(dates: DataFrame, n_folds: int = fv.CV_FOLDS, date: str = "aligned_date") -> DataFrame:
    """(fold, train_cutoff, test_end) of an expanding window over the distinct dates.

    No rows when there are too few dates. Dates are as many as the calendar has, so they are numbered
    in one task.
    """
    distinct = dates.select(F.col(date).alias("d")).distinct()
    numbered = distinct.withColumn("k", F.row_number().over(Window.partitionBy().orderBy("d")) - 1)
    listed = numbered.agg(F.count(F.lit(1)).alias("n"),
                          F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda p: p["d"])
                          .alias("days"))
    size = F.floor(F.col("n") / (n_folds + 1)).cast("int")
    last = (F.col("n") - 1).cast("int")

    def at(step: Column) -> Column:
        return F.get("days", F.least(step * size, last))

    folds = F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold")
    return listed.filter(F.col("n") >= n_folds + 1).select("*", folds).select(
        "fold", at(F.col("fold")).alias("train_cutoff"), at(F.col("fold") + 1).alias("test_end"))


def fold_rows(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows once per fold they belong to, with ``part`` train or test.

    The handful of bounds travels as one array beside every row.
    """
    listed = bounds.agg(F.collect_list(F.struct("fold", "train_cutoff", "test_end"))).scalar()
    day = F.col("aligned_date")
    part = F.when(day <= F.col("_b.train_cutoff"), "train").otherwise("test")
    return (rows.withColumn("_b", F.explode(listed)).filter(day <= F.col("_b.test_end"))
            .withColumn("fold", F.col("_b.fold")).withColumn("part", part).drop("_b"))


def fold_sizes(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Sizes and class counts of every fold, with the guard on both parts."""
    train, test = F.col("part") == "train", F.col("part") == "test"
    sizes = fold_rows(rows, bounds).groupBy("fold").agg(
        F.count_if(train).alias("train_size"), F.count_if(test).alias("test_size"),
        F.count_distinct(F.when(train, F.col("label"))).alias("train_classes"),
        F.count_distinct(F.when(test, F.col("label"))).alias("test_classes"))
    usable = ((F.col("train_size") >= fv.MIN_FOLD_TRAIN) & (F.col("test_size") >= fv.MIN_FOLD_TEST)
              & (F.col("train_classes") >= 2) & (F.col("test_classes") >= 2))
    return sizes.withColumn("usable", usable)


def chronological_split(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """``part`` train for the first share of the rows by date and id, test for the rest."""
    order = ["aligned_date", "id"]
    numbered = row_numbers(ordered_runs(rows, order), "_row", order)
    cut = F.floor(numbered.agg(F.max("_row")).scalar() * share)
    return numbered.withColumn("part", F.when(F.col("_row") <= cut, "train").otherwise("test")) \
        .drop("run", "_row")


def group_training_set(rows: DataFrame, group: str, again: DataFrame | None = None) -> DataFrame:
    """Rows of a commodity group together with the general ones.

    With ``again``, the ids that several rows have, only rows of these and of no id are shuffled.
    """
    def of(some: DataFrame) -> list[DataFrame]:
        return [some.filter(F.col("commodity_group") == g) for g in (group, fv.GENERAL_GROUP)]

    if again is None:
        return union_distinct_by_id(of(rows), "id")
    marked = rows.join(again.select("id", F.lit(True).alias("_again")), "id", "left")
    marked = marked.withColumn("_again", F.col("id").isNull() | F.coalesce("_again", F.lit(False)))
    once = rows.columns
    own, general = of(marked.filter("not _again").select(once))
    alone = own if group == fv.GENERAL_GROUP else own.unionByName(general)
    return alone.unionByName(union_distinct_by_id(of(marked.filter("_again").select(once)), "id"))


def with_embedding(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows with the ``embedding`` of their id from ``vectors`` (id, embedding); one that is missing is the zero vector."""
    size = vectors.agg(F.max(F.size("embedding"))).scalar()
    zero = F.array_repeat(F.lit(0.0).cast("float"), F.coalesce(size, F.lit(1)))
    return rows.join(vectors.select("id", "embedding"), "id", "left").withColumn("embedding", F.coalesce("embedding", zero))


# --- classifiers ----------------------------------------------------------------------------------


@dataclass
class TextModel:
    """Fitted classifiers with everything needed to turn rows into their feature vectors.

    A logistic model is one classifier; boosted trees are one classifier per label, in the order of labels.
    """

    classifiers: list
    labels: list[str]
    vocab: DataFrame
    vocab_size: int
    numeric: Sequence[str] = ()
    stats: DataFrame | None = None
    embedding: str | None = None
    settings: dict = field(default_factory=dict)

    def vectors(self, rows: DataFrame, counts: DataFrame | None = None, terms: Sequence[str] | None = None) -> DataFrame:
        return assemble(rows, self.vocab, self.vocab_size, self.numeric, self.stats, self.embedding, counts, terms)

    def score(self, rows: DataFrame, counts: DataFrame | None = None, terms: Sequence[str] | None = None) -> DataFrame:
        """(id, label if known, prediction, and a probability per class).

        ``counts``: the terms of ``rows``, if they have been counted already; ``terms``: as for :func:`assemble`.

        The probabilities of boosted trees are those of the classes against the rest, scaled to sum to 1.
        The prediction is the most probable class, the first on a tie.
        """
        scored = self.vectors(rows, counts, terms)
        kept = scored.columns
        if self.settings.get("kind") == "trees":
            for i, classifier in enumerate(self.classifiers):
                done = classifier.transform(scored)
                scored = done.select(*[c for c in done.columns if c not in ("prediction", "rawPrediction", "probability")],
                                     F.get(vector_to_array("probability"), F.lit(1)).alias(f"_p{i}"))
            total = sum((F.col(f"_p{i}") for i in range(len(self.labels))), F.lit(0.0))
            share = F.array(*[F.col(f"_p{i}") / total for i in range(len(self.labels))])
        else:
            scored = self.classifiers[0].transform(scored)
            share = vector_to_array("probability")
        scored = scored.select(*kept, share.alias("_share"))
        names = F.array(*[F.lit(name) for name in self.labels])
        best = F.array_position("_share", F.array_max("_share")).cast("int") - 1
        return scored.select(*kept, F.get(names, best).alias("prediction"),
                             *[F.get("_share", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(self.labels)])


def assemble(rows: DataFrame, vocab: DataFrame, size: int, numeric: Sequence[str] = (), stats: DataFrame | None = None,
             embedding: str | None = None, counts: DataFrame | None = None, terms: Sequence[str] | None = None) -> DataFrame:
    """Rows with a ``features`` vector: embedding, term weights, scaled numbers.

    With ``terms``, the rows hold a vector of the counts of these terms (column ``terms``), and nothing is shuffled; ids may
    repeat or be null. Without, ids are unique.
    """
    if terms is None:
        weights = feat.tfidf(feat.term_counts(rows) if counts is None else counts, vocab)
        out = rows.join(feat.text_vectors(weights, size), "id", "left")
        empty = feat.sparse_vector(size, F.array().cast("array<struct<idx:int,weight:double>>"))
        out = out.withColumn("text_vector", F.coalesce("text_vector", empty))
        if numeric:
            out = out.drop(*numeric).join(feat.scaled(rows.select("id", *numeric), stats, numeric), "id")
    else:
        out = feat.weighted_vectors(feat.scaled(rows, stats, numeric) if numeric else rows, terms, vocab, size)
    # without the size the assembler computes a first row, and with it the shuffles before it
    out = VectorSizeHint(inputCol="text_vector", size=size, handleInvalid="optimistic").transform(out)
    inputs = ["text_vector", *numeric]
    if embedding:
        out = out.withColumn("embedding_vector", array_to_vector(F.col(embedding).cast("array<double>")))
        inputs = ["embedding_vector", *inputs]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(out)


def repeated(rows: DataFrame) -> DataFrame:
    """(id, n_rows): the ids that several rows have. Written once, so that Spark knows how few they are."""
    return checkpointed(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows")).filter("id is not null and n_rows > 1"))


def numbered_vocabularies(counts: DataFrame, n: int, sizes: Sequence[int]) -> list[DataFrame]:
    """For each of ``sizes`` the vocabulary (term, idf, idx) of a model of at most so many terms, from one pass over ``counts``."""
    stats = checkpointed(feat.vocabulary(counts, n, max_features=max(sizes)).select("term", "df", "total"))
    return [checkpointed(feat.vocabulary_of(stats, n, max_features=size).select("term", "idf", "idx")) for size in sizes]


def counted_rows(rows: DataFrame, vocabs: Sequence[DataFrame]) -> tuple[DataFrame, list[str]]:
    """Rows whose text is replaced by a vector of the counts of the terms of ``vocabs`` (column ``terms``), and these terms.

    A row per document, whatever its length; the vocabularies are limited.
    """
    terms = sorted({r["term"] for vocab in vocabs for r in vocab.select("term").collect()})
    return checkpointed(feat.term_vectors(rows, terms).drop("text")), terms


def _indexed(rows: DataFrame, labels: list[str]) -> DataFrame:
    position = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("label")) - 1
    return rows.withColumn("y", position.cast("double"))


MOST_LABELS = 100
ROWS_PER_TASK = 2000
MOST_ROWS_PER_TASK = 50_000


def _parts(n: int, cores: int, learners: int = 1) -> int:
    """Partitions for ``n`` vectors: the share of the cores that each of the learners side by side has, fewer for few
    rows, and more where a partition would hold more than ``MOST_ROWS_PER_TASK``."""
    return max(1, min(-(-n // ROWS_PER_TASK), max(-(-cores // learners), -(-n // MOST_ROWS_PER_TASK))))


def _gathered(rows: DataFrame, n: int, learners: int = 1) -> DataFrame:
    """Vectors in few partitions: a learner runs a job per step, and every partition hands on statistics of all features,
    however few rows it has."""
    return rows.repartition(_parts(n, rows.sparkSession.sparkContext.defaultParallelism, learners))


def fit_text_model(train: DataFrame, kind: str = "logistic", numeric: Sequence[str] = (),
                   embedding: str | None = None, max_features: int | None = None, top_k: int | None = None,
                   max_iter: int = fv.LOGISTIC_MAX_ITER, trees: int = fv.FINAL_TREES["trees"],
                   depth: int = fv.FINAL_TREES["depth"], step: float = fv.FINAL_TREES["step"],
                   counts: DataFrame | None = None, term_stats: DataFrame | None = None,
                   vocab: DataFrame | None = None, terms: Sequence[str] | None = None) -> TextModel:
    """Fit a classifier on id, label, text and optional numeric and embedding columns.

    ``kind='logistic'``: multinomial logistic regression with balanced classes on all terms, until it
    converges or for ``max_iter`` iterations.
    ``kind='trees'``: one boosted-tree classifier per class on the ``top_k`` terms by chi-square, fitted side
    by side. There may be at most ``MOST_LABELS`` labels.
    Term counts, vocabulary and scaling are written once; the vectors are cached while the learner passes over them, those
    of the logistic regression on disk or, with ``terms``, in a table that is deleted after the fit, as it keeps them in memory itself.
    ``counts`` and ``term_stats`` (term, df, total) are those of ``train``, if they are known already. With ``terms``, as for
    :func:`assemble`, and the numbered ``vocab`` of ``train``, a model needs neither.
    """
    found = train.select("label").distinct().orderBy("label").limit(MOST_LABELS + 1).collect()
    labels = [row["label"] for row in found]
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    n = train.count()
    size = max_features or (fv.LOGISTIC_MAX_FEATURES if kind == "logistic" else fv.TREE_MAX_FEATURES)
    if terms is None:
        counts = checkpointed(feat.term_counts(train)) if counts is None else counts
        vocab = feat.vocabulary(counts, n, max_features=size) if term_stats is None else feat.vocabulary_of(term_stats, n, max_features=size)
    if top_k or kind == "trees":
        size = top_k or fv.TREE_TOP_TERMS
        vocab = checkpointed(vocab) if terms is None else vocab
        if terms is None:
            scores = feat.chi2_scores(feat.tfidf(counts, vocab), train.select("id", "label"), labels)
        else:
            known = max_features or fv.TREE_MAX_FEATURES
            scores = feat.chi2_scores(feat.weighted_vectors(train.select("label", "terms"), terms, vocab, known),
                                      train.select("label"), labels, vocab=vocab)
        chosen = feat.top_terms(scores, size)
        vocab = vocab.drop("idx").join(chosen.select("term", "idx"), "term")
    vocab = checkpointed(vocab.select("term", "idf", "idx")) if terms is None or top_k or kind == "trees" else vocab
    stats = checkpointed(feat.scaling(train, numeric)) if numeric else None
    rows, table = _indexed(assemble(train, vocab, size, numeric, stats, embedding, counts, terms), labels), None
    if kind == "logistic":
        rows = rows.join(F.broadcast(feat.class_weights(train).select("label", "weight")), "label")
        rows = rows.select("y", "weight", "features")
        cores = rows.sparkSession.sparkContext.defaultParallelism
        table = checkpointed(rows) if terms is not None else None
        rows = _gathered(rows, n).persist(StorageLevel.DISK_ONLY) if table is None else table.coalesce(_parts(n, cores))
    else:
        rows = _gathered(rows.select("y", "features"), n, min(4, len(labels))).persist()
    try:
        if kind == "logistic":
            classifiers = [LogisticRegression(
                featuresCol="features", labelCol="y", weightCol="weight", family="multinomial",
                maxIter=max_iter, tol=fv.LOGISTIC_TOLERANCE, regParam=1.0 / max(n, 1), standardization=False).fit(rows)]
        else:
            learner = GBTClassifier(
                featuresCol="features", labelCol="target", maxIter=trees, maxDepth=depth, stepSize=step,
                subsamplingRate=fv.TREE_ROW_SHARE, featureSubsetStrategy=fv.TREE_COLUMN_SHARE, seed=42)
            rows.count()

            def one(k: int):
                return learner.fit(rows.select("features", (F.col("y") == k).cast("double").alias("target")))

            with ThreadPool(min(4, len(labels))) as pool:
                classifiers = pool.map(one, range(len(labels)))
        return TextModel(classifiers, labels, vocab, size, tuple(numeric), stats, embedding, {"kind": kind, "n": n})
    finally:
        rows.unpersist()
        if table is not None:
            forget(table)


def fold_metrics(scored: DataFrame, labels: Sequence[str], top_label: str) -> DataFrame:
    """Accuracy, and precision and recall of the top class, as shares."""
    report = class_report(scored, labels).filter(F.col("class") == top_label)
    return report.select((F.col("accuracy_pct") / 100).alias("accuracy"),
                         (F.col("precision_pct") / 100).alias("high_precision"),
                         (F.col("recall_pct") / 100).alias("high_recall"))


_VALIDATION = dict(fv.VALIDATION_TREES)


def _stats_of(stats: DataFrame, k: int) -> DataFrame:
    """(term, df, total) of the k-th cutoff of :func:`features.stats_until`."""
    return stats.select("term", F.get("stats", F.lit(k)).alias("s")).select("term", "s.*").filter("df > 0")


def walk_forward(rows: DataFrame, model_type: str = "logistic", label_type: str = "magnitude",
                 n_folds: int = fv.CV_FOLDS, single_split: bool = True, **settings) -> DataFrame:
    """Fold metrics of an expanding-window validation; without usable folds those of one 80/20 split, or with
    ``single_split=False`` none.

    Documents are cut into terms and counted once for all folds. For the logistic model only the terms that some fold
    knows are counted per document, as a vector in its row; the texts are cut once more for that. The driver loops over
    the few folds; everything inside a fold is distributed.
    """
    bounds = fold_bounds(rows, n_folds).persist()
    try:
        sizes = fold_sizes(rows, bounds).filter("usable")
        usable = sizes.join(bounds, "fold").orderBy("fold").collect()
    finally:
        bounds.unpersist()
    top = "HIGH" if label_type == "magnitude" else "rise"
    labels = ["HIGH", "LOW", "MEDIUM"] if label_type == "magnitude" else ["fall", "flat", "rise"]
    results = []
    day, counts, terms, vocabs = F.col("aligned_date"), None, None, []
    cutoffs = [f["train_cutoff"] for f in usable]
    if usable and (model_type != "logistic" or settings.get("top_k")):
        counts = checkpointed(feat.term_counts(rows, keep=["aligned_date"]))
        stats = checkpointed(feat.stats_until(counts, "aligned_date", cutoffs))
    elif usable:
        found = feat.text_stats_until(rows, "aligned_date", cutoffs)
        stats = checkpointed(found.filter(F.get("stats", F.lit(len(usable) - 1))["df"] >= 2))  # others are in no vocabulary
        size = settings.get("max_features") or fv.LOGISTIC_MAX_FEATURES
        vocabs = [checkpointed(feat.vocabulary_of(_stats_of(stats, k), f["train_size"], max_features=size).select("term", "idf", "idx"))
                  for k, f in enumerate(usable)]
        terms = sorted({r["term"] for vocab in vocabs for r in vocab.select("term").collect()})  # at most ``size`` a fold
        kept = ["id", "aligned_date", "label", "text", *settings.get("numeric", ()), *filter(None, [settings.get("embedding")])]
        rows = checkpointed(feat.term_vectors(rows.select(*kept), terms).drop("text"))
    for k, f in enumerate(usable):
        trained, tested = day <= F.lit(f["train_cutoff"]), (day > F.lit(f["train_cutoff"])) & (day <= F.lit(f["test_end"]))
        if terms is None:
            model = fit_text_model(rows.filter(trained), model_type, counts=counts.filter(trained).drop("aligned_date"),
                                   term_stats=_stats_of(stats, k), **{**_VALIDATION, **settings})
            scored = model.score(rows.filter(tested), counts.filter(tested).drop("aligned_date"))
        else:
            model = fit_text_model(rows.filter(trained), model_type, vocab=vocabs[k], terms=terms, **{**_VALIDATION, **settings})
            scored = model.score(rows.filter(tested), terms=terms)
        results.append(fold_metrics(scored, labels, top).select(
            F.lit(model_type).alias("model_type"), F.lit(label_type).alias("label_type"),
            F.lit(f["fold"]).alias("fold"), F.lit(f["train_size"]).alias("train_size"),
            F.lit(f["test_size"]).alias("test_size"), "accuracy", "high_precision", "high_recall",
            F.lit(f["train_cutoff"]).alias("train_cutoff"), F.lit(f["test_end"]).alias("test_end")))
    if not results:
        from newsignal.schemas import MODEL_METRICS
        none = rows.sparkSession.createDataFrame([], MODEL_METRICS)
        if not single_split:
            return none
        split = chronological_split(rows)
        train, test = split.filter("part = 'train'"), split.filter("part = 'test'")
        n_train, n_test = train.count(), test.count()
        if n_train < fv.MIN_FOLD_TRAIN or n_test < fv.MIN_FOLD_TEST:
            return none
        scored = fit_text_model(train, model_type, **{**_VALIDATION, **settings}).score(test)
        none = F.lit(None).cast("date")
        results.append(fold_metrics(scored, labels, top).select(
            F.lit(model_type).alias("model_type"), F.lit(label_type).alias("label_type"),
            F.lit(1).alias("fold"), F.lit(n_train).alias("train_size"), F.lit(n_test).alias("test_size"),
            "accuracy", "high_precision", "high_recall", none.alias("train_cutoff"), none.alias("test_end")))
    out = results[0]
    for df in results[1:]:
        out = out.unionByName(df)
    return out


def group_models(rows: DataFrame, groups: Sequence[str] = tuple(g for g, _ in fv.GROUP_KEYWORDS),
                 min_samples: int = fv.MIN_SAMPLES, counts: DataFrame | None = None,
                 vocabs: dict[str, DataFrame] | None = None, terms: Sequence[str] | None = None,
                 again: DataFrame | None = None, **settings) -> dict[str, TextModel]:
    """One text model per commodity group that has enough rows.

    ``counts``: the terms of ``rows``, if they have been counted already; a group takes those of its rows.
    With ``terms``, as for :func:`assemble`, and the ids ``again`` that rows share, ``vocabs`` has the vocabulary of each group
    with enough rows.
    """
    models = {}
    for group in groups:
        subset = group_training_set(rows, group, again)
        if subset.count() >= min_samples:
            own = None if counts is None else counts.join(subset.select("id"), "id", "left_semi")
            models[group] = fit_text_model(subset, max_features=fv.GROUP_MAX_FEATURES, counts=own, terms=terms,
                                           vocab=vocabs[group] if vocabs else None, **settings)
    return models


def group_vocabularies(rows: DataFrame, groups: Sequence[str], again: DataFrame, min_samples: int = fv.MIN_SAMPLES) -> dict[str, DataFrame]:
    """The vocabularies of the models of :func:`group_models`, from one pass over the terms of ``rows``."""
    sizes = {g: group_training_set(rows.select("id", "commodity_group"), g, again).count() for g in groups}
    usable = [g for g in groups if sizes[g] >= min_samples]
    if not usable:
        return {}
    counts = feat.term_counts(rows, keep=["commodity_group"])
    stats = feat.stats_of_groups(counts, "commodity_group", [[g, fv.GENERAL_GROUP] for g in usable])
    stats = checkpointed(stats.filter(F.exists("stats", lambda s: s["df"] >= 2)))  # others are in no vocabulary
    return {g: checkpointed(feat.vocabulary_of(_stats_of(stats, k), sizes[g], max_features=fv.GROUP_MAX_FEATURES).select("term", "idf", "idx"))
            for k, g in enumerate(usable)}


def long_scores(models: dict[str, TextModel], rows: DataFrame, counts: DataFrame | None = None,
                terms: Sequence[str] | None = None, again: DataFrame | None = None) -> DataFrame:
    """Probabilities of several models in long form (article_id, model, class, p).

    ``counts``: the terms of ``rows``, if they have been counted already; ``terms``: as for :func:`assemble`. With ``again``
    of :func:`repeated`, the rows of one id share a probability, so that their sum is their mean.
    """
    out = None
    for name, model in models.items():
        scored = model.score(rows, counts, terms)
        if again is not None:
            scored = scored.join(again, "id", "left").withColumns(
                {f"p_{c}": F.col(f"p_{c}") / F.coalesce("n_rows", F.lit(1)) for c in model.labels})
        per_class = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("p"))
                              for c in model.labels])
        part = scored.select(F.col("id").alias("article_id"), F.lit(name).alias("model"), F.inline(per_class))
        out = part if out is None else out.unionByName(part)
    return out


def save_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)


def save_model(model: TextModel, path: str) -> None:
    """Classifiers, vocabulary and scaling beside each other."""
    spark = model.vocab.sparkSession
    for k, classifier in enumerate(model.classifiers):
        classifier.write().overwrite().save(f"{path}/classifier-{k}")
    model.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
    if model.stats is not None:
        model.stats.write.mode("overwrite").parquet(f"{path}/scaling")
    info = spark.range(1).select(
        F.array(*[F.lit(c) for c in model.labels]).alias("labels"), F.lit(model.vocab_size).alias("vocab_size"),
        F.array(*[F.lit(c) for c in model.numeric]).cast("array<string>").alias("numeric"),
        F.lit(model.embedding).cast("string").alias("embedding"),
        F.lit(model.settings.get("kind")).alias("kind"))
    info.write.mode("overwrite").json(f"{path}/info")


def load_model(spark, path: str) -> TextModel:
    info = spark.read.schema("labels array<string>, vocab_size int, numeric array<string>, "
                             "embedding string, kind string").json(f"{path}/info").first()
    loader, many = (LogisticRegressionModel, 1) if info["kind"] == "logistic" else (GBTClassificationModel, len(info["labels"]))
    stats = spark.read.parquet(f"{path}/scaling") if info["numeric"] else None
    return TextModel([loader.load(f"{path}/classifier-{k}") for k in range(many)], info["labels"],
                     spark.read.parquet(f"{path}/vocabulary"), info["vocab_size"],
                     tuple(info["numeric"]), stats, info["embedding"], {"kind": info["kind"]})
