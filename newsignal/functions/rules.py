"""Keyword rules. A keyword matches as a substring, also inside a word.

Rule lists that come with the package are literals, so the rules become expressions of the scan
stage: no join, no shuffle. Expressions over several rules should share one lowercase column of the text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.config import lookup

Rules = Sequence[tuple[str, Sequence[str]]]


def any_keyword(text: Column, keywords: Sequence[str], whole_words: bool = False) -> Column:
    """True when at least one keyword occurs in the (lowercase) text."""
    if whole_words:
        return text.rlike(rf"\b(?:{'|'.join(rf'\Q{word}\E' for word in keywords)})\b")
    # a byte search per keyword is much cheaper than one regular expression of alternatives
    return reduce(lambda a, b: a | b, [text.contains(word) for word in keywords])


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur (each counted once)."""
    return reduce(lambda a, b: a + b, [text.contains(word).cast("int") for word in keywords])


def first_match(text: Column, rules: Rules, default: str) -> Column:
    """Value of the first rule with a keyword in the text."""
    chain = F
    for value, keywords in rules:
        chain = chain.when(any_keyword(text, keywords), F.lit(value))
    return chain.otherwise(F.lit(default))


def max_count(text: Column, groups: Rules, default: str) -> Column:
    """Group with most of its keywords present; the declared order breaks ties."""
    scored = F.array(*[
        F.struct(keyword_hits(text, words).alias("hits"), F.lit(-order).alias("rank"),
                 F.lit(group).alias("group"))
        for order, (group, words) in enumerate(groups)])
    best = F.array_max(scored)
    return F.when(best["hits"] > 0, best["group"]).otherwise(F.lit(default))


def matched_groups(text: Column, groups: Rules) -> Column:
    """Array of all groups that have a keyword in the text."""
    return F.filter(
        F.array(*[F.when(any_keyword(text, words), F.lit(group)) for group, words in groups]),
        lambda group: group.isNotNull())


def match_rule_table(df: DataFrame, text: Column, rules: DataFrame, default: str, max_rules: int = 5000) -> DataFrame:
    """First-match routing with a user-supplied rule table (rule_order, keyword, value).

    A text takes the value of the least (rule_order, keyword) whose keyword it holds; an empty keyword is held by every
    text, a null one by none, and a null text gets the default. A table of at most ``max_rules`` rows becomes an array
    literal beside each text, so texts are neither multiplied nor shuffled. A longer one is joined with the same result,
    whatever ids the rows have: the text alone decides (:func:`_match_by_openings`).
    """
    known = rules.filter("keyword is not null").select("rule_order", "keyword", "value")
    listed = known.limit(max_rules + 1).collect()
    if len(listed) > max_rules:
        return _match_by_openings(df, text, known, default)
    if not listed:
        return df.withColumn("matched", F.lit(default))
    table = F.array(*[
        F.struct(F.lit(r.rule_order).alias("rule_order"), F.lit(r.keyword).alias("keyword"),
                 F.lit(r.value).alias("value"))
        for r in sorted(listed, key=lambda r: (r.rule_order, r.keyword, r.value or ""))])
    hits = F.filter(table, lambda rule: F.contains(text, rule["keyword"]))
    return df.withColumn("matched", F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(default)))


def _length_class(size: Column) -> Column:
    """Largest power of two that is at most ``size``."""
    return F.pow(F.lit(2), F.floor(F.log2(size))).cast("int")


def _match_by_openings(df: DataFrame, text: Column, rules: DataFrame, default: str) -> DataFrame:
    """Rule table of any size, as rolling hashes of the texts.

    A keyword is hashed over its opening of a power of two characters. A text is hashed over all its runs of the lengths
    that occur, and equal hashes are verified. Different texts are matched once each, and the match is joined by the text.
    """
    wanted = rules.filter("keyword <> ''")
    opening = _length_class(F.length("keyword"))
    keyed = wanted.select("rule_order", "keyword", "value", F.xxhash64(F.substring("keyword", F.lit(1), opening), opening).alias("_hash"))
    classes = sorted(row[0] for row in wanted.select(opening.alias("c")).distinct().collect())  # about twenty at most
    texts = df.select(text.alias("_text")).filter("_text is not null").distinct()

    def runs(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("_text") - size + 1)
        return F.when(F.length("_text") >= size, F.array_distinct(F.transform(
            starts, lambda at: F.xxhash64(F.substring(F.col("_text"), at, F.lit(size)), F.lit(size)))))

    hashes = F.flatten(F.array_compact(F.array(*[runs(size) for size in classes])))
    found = (texts.select("_text", F.explode(hashes).alias("_hash")).join(keyed, "_hash").filter(F.contains("_text", "keyword"))
             .groupBy("_text").agg(F.min(F.struct("rule_order", "keyword", "value")).alias("_best")))
    everywhere = rules.filter("keyword = ''").agg(F.min(F.struct("rule_order", "keyword", "value"))).scalar()
    joined = df.join(found, text.eqNullSafe(F.col("_text")), "left")
    best = F.least(F.col("_best"), F.when(text.isNotNull(), everywhere))  # nulls are skipped
    return joined.withColumn("matched", F.coalesce(best["value"], F.lit(default))).drop("_best", "_text")


# --- articles and headlines ---------------------------------------------------------------------


def routing_text(headline: Column, body: Column, body_chars: int | None = None) -> Column:
    """Text that decides the price symbol: headline and body.

    ``body_chars`` (``fv.ROUTING_BODY_CHARS`` in the published rule) restricts it to the opening of the body.
    """
    body = F.coalesce(body, F.lit(""))
    return F.lower(F.concat(F.coalesce(headline, F.lit("")), F.lit(" "),
                            F.substring(body, 1, body_chars) if body_chars else body))


def price_symbol(headline: Column, body: Column, rules: Rules = fv.ROUTING_RULES,
                 default: str = fv.DEFAULT_SYMBOL) -> Column:
    return first_match(routing_text(headline, body), rules, default)


def lowered(text: Column) -> Column:
    """The text as all rules read it; put it into a column when several rules use it."""
    return F.lower(F.coalesce(text, F.lit("")))


def event_type(headline: Column, rules: Rules = fv.EVENT_RULES) -> Column:
    return first_match(lowered(headline), rules, fv.DEFAULT_EVENT)


def region(headline: Column, rules: Rules = fv.REGION_RULES) -> Column:
    return first_match(lowered(headline), rules, fv.DEFAULT_REGION)


def supply_impact(headline: Column, words: Sequence[str] = fv.SUPPLY_IMPACT_WORDS) -> Column:
    return any_keyword(lowered(headline), words)


def impact_score(event: Column) -> Column:
    return lookup(fv.IMPACT_SCORES, event, fv.DEFAULT_IMPACT)


def commodity_group(headline: Column, groups: Rules = fv.GROUP_KEYWORDS) -> Column:
    return max_count(lowered(headline), groups, fv.GENERAL_GROUP)


def entity_frame(df: DataFrame, column: str) -> DataFrame:
    """Add event_type, region, supply_impact and impact_score of a text column.

    Each step is a projection of its own: the lowercase text and the event are computed once.
    """
    staged = df.withColumn("_lower", lowered(F.col(column)))
    t = F.col("_lower")
    staged = staged.withColumns({
        "event_type": first_match(t, fv.EVENT_RULES, fv.DEFAULT_EVENT),
        "region": first_match(t, fv.REGION_RULES, fv.DEFAULT_REGION),
        "supply_impact": any_keyword(t, fv.SUPPLY_IMPACT_WORDS).cast("int")}).drop("_lower")
    return staged.withColumn("impact_score", impact_score(F.col("event_type")))


def is_generic_headline(headline: Column) -> Column:
    from newsignal.functions.text import strip
    title = strip(F.lower(F.coalesce(headline, F.lit(""))))
    return any_keyword(title, fv.GENERIC_HEADLINES) | (F.length(title) < fv.GENERIC_HEADLINE_MIN_CHARS)


def is_real_news(headline: Column, body: Column) -> Column:
    from newsignal.functions.text import strip
    title = strip(F.lower(F.coalesce(headline, F.lit(""))))
    return (F.length(F.coalesce(body, F.lit(""))) > fv.REAL_NEWS_BODY_CHARS) | (
        (F.length(title) > fv.REAL_NEWS_HEADLINE_CHARS) & ~any_keyword(title, fv.NEWS_NOISE_NAMES))


QUICK_SUPPLY_EVENTS = ("sanctions", "pipeline_outage")


def quick_event(t: Column) -> Column:
    """Coarse event of a lowercase text."""
    refinery = t.contains("refinery") & (t.contains("outage") | t.contains("maintenance"))
    return (F.when(t.contains("opec"), "opec_decision")
            .when(t.contains("sanction"), "sanctions")
            .when(refinery, "refinery_maintenance")
            .when(any_keyword(t, fv.QUICK_PIPELINE), "pipeline_outage")
            .when(any_keyword(t, fv.QUICK_SHIPPING), "shipping_disruption")
            .when(any_keyword(t, fv.QUICK_DEMAND), "demand_change")
            .otherwise(fv.DEFAULT_EVENT))


def quick_entities(text: Column) -> Column:
    """Coarse entities used while scoring: event, region, sentiment and supply flag in one struct."""
    t = lowered(text)
    event = quick_event(t)
    sentiment = (F.when(any_keyword(t, fv.QUICK_TIGHT), fv.QUICK_TIGHT_SENTIMENT)
                 .when(any_keyword(t, fv.QUICK_LOOSE), fv.QUICK_LOOSE_SENTIMENT).otherwise(0.0))
    return F.struct(
        event.alias("event_type"),
        first_match(t, fv.QUICK_REGIONS, fv.DEFAULT_REGION).alias("region"),
        sentiment.alias("sentiment"), event.isin(*QUICK_SUPPLY_EVENTS).alias("supply_impact"))


def is_uuid(value: Column) -> Column:
    return normal_id(value).rlike(fv.UUID_PATTERN.replace("^", r"\A").replace("$", r"\z"))


def normal_id(value: Column) -> Column:
    from newsignal.functions.text import strip
    return F.lower(strip(F.coalesce(value, F.lit(""))))
