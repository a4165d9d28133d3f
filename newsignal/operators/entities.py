"""Rule-based entities of headlines and lexicon sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.functions import rules, text


MOST_WORDS = 500_000


def lexicon_sentiment(articles: DataFrame, lexicon: DataFrame, column: str = "headline",
                      key: str = "id") -> DataFrame:
    """(key, sentiment): mean polarity of the words that are in the lexicon, 0 without any.

    ``lexicon``: word, polarity, one row per word. One of at most ``MOST_WORDS`` rows is broadcast, so words are
    not shuffled; for a larger one the words of an article are counted first, and the counts are joined.
    """
    words = articles.select(
        key, F.explode_outer(text.tokens(F.coalesce(F.col(column), F.lit("")))).alias("word")) \
        .filter("word is not null")  # outer: no inferred filter that would cut the text twice
    if lexicon.limit(MOST_WORDS + 1).count() <= MOST_WORDS:
        means = words.join(F.broadcast(lexicon), "word").groupBy(key).agg(F.avg("polarity").alias("_mean"))
    else:
        counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("_n")).join(lexicon, "word")
        means = counted.groupBy(key).agg((F.sum(F.col("polarity") * F.col("_n")) / F.sum(
            F.when(F.col("polarity").isNotNull(), F.col("_n")))).alias("_mean"))
    return articles.select(key).join(means, key, "left").select(
        key, F.coalesce(F.round("_mean", 4), F.lit(0.0)).alias("sentiment"))


def extract_entities(articles: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Entity row per article; without a lexicon the sentiment is 0."""
    rows = rules.entity_frame(articles.select(F.col("id").alias("article_id"), "headline"), "headline")
    if lexicon is None:
        rows = rows.withColumn("sentiment", F.lit(0.0))
    else:
        rows = rows.join(lexicon_sentiment(articles, lexicon).withColumnRenamed("id", "article_id"),
                         "article_id")
    return rows.select("article_id", "event_type", "region", "sentiment", "supply_impact", "impact_score")


def unprocessed(labelled: DataFrame, entities: DataFrame) -> DataFrame:
    """Labelled articles that have no entity row yet."""
    return labelled.join(entities.select(F.col("article_id").alias("id")), "id", "left_anti")


def with_entities(labelled: DataFrame, entities: DataFrame) -> DataFrame:
    """Labelled articles with their entities, where there are any."""
    return labelled.join(entities.withColumnRenamed("article_id", "id"), "id", "left")


def word_balance(df: DataFrame, column: str = "headline") -> DataFrame:
    """Add the number of bullish and bearish words that occur in a text column."""
    staged = df.withColumn("_lower", rules.lowered(F.col(column)))
    return staged.withColumns({"bull_hits": rules.keyword_hits(F.col("_lower"), fv.BULL_WORDS),
                               "bear_hits": rules.keyword_hits(F.col("_lower"), fv.BEAR_WORDS)}).drop("_lower")


def explanation(label: Column, score: Column, quick: Column) -> Column:
    """Plain-language explanation from the quick entities."""
    event = F.replace(quick["event_type"], F.lit("_"), F.lit(" "))
    mood = F.when(quick["sentiment"] >= 0, "bullish").otherwise("bearish")
    pattern = F.when(quick["supply_impact"], "supply disruption").otherwise("market development")
    return F.concat(
        F.lit("This article describes a "), event, F.lit(" event in "), quick["region"],
        F.lit(", which historically triggers "), mood, F.lit(" price reactions in energy markets. "
              "The ML model assigned "), label, F.lit(" impact ("),
        F.round(score * 100, 0).cast("int").cast("string"), F.lit("% confidence) based on similar "),
        pattern, F.lit(" patterns in the training data."))


def web_articles(pages: DataFrame) -> DataFrame:
    """Web items with an id that is stable for a URL, one row per URL (the first that arrived)."""
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id")).select(
        F.concat(F.lit("web-"), F.substring(F.md5("url"), 1, 16)).alias("id"), "url", "page_id")
