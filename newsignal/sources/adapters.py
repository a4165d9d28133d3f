"""News-desk tables derived from the generic test tables.

Every adapter reads a whole table. Order priorities stand for price symbols and commodities, documents
for articles, and deterministic arithmetic on keys for what the test tables do not hold (signals,
confidences, model probabilities).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.functions import trading
from newsignal.functions.numbers import half_up
from newsignal.sources.tables import read_table, read_texts

SYMBOL_OF_PRIORITY = {"1-URGENT": "Dubai", "2-HIGH": "Brent", "3-MEDIUM": "WTI",
                      "4-NOT SPECIFIED": "Oman", "5-LOW": "Dubai"}
COMMODITY_OF_PRIORITY = {"1-URGENT": "Dubai Crude (PCAAT00)", "2-HIGH": "Brent Dated (PCAAS00)",
                         "3-MEDIUM": "WTI (PCACG00)", "4-NOT SPECIFIED": "LNG / Nat Gas (JKM)",
                         "5-LOW": "Dubai Crude"}
TICKERS = ["CL=F", "BZ=F", "NG=F"]

# word fragments that are frequent in the test documents, as stand-ins for the energy keywords
DESK_ROUTING = [("Oman", ["eaux", "ique"]), ("WTI", ["nterti", "thorr"]), ("Brent", ["ing", "schen"]),
                ("Dubai", ["tion", "der"])]
DESK_KEYWORDS = [("Dubai Crude (PCAAT00)", ["tion", "eau"]), ("Brent Dated (PCAAS00)", ["ing", "sch"]),
                 ("WTI (PCACG00)", ["nter", "ther"]), ("LNG / Nat Gas (JKM)", ["lng", "jkm"])]
DESK_NOISE = [*fv.LABEL_NOISE_REPORTS, "src3"]
EVENT_NAMES = list(fv.IMPACT_SCORES)


def _mapped(mapping: dict, key: str) -> Column:
    chain = F
    for source, target in mapping.items():
        chain = chain.when(F.col(key) == source, target)
    return chain


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """(date, symbol, price, pct_change_24h), one row per date and symbol."""
    daily = read_table(spark, folder, "orders", ["o_orderdate", "o_orderpriority", "o_totalprice"])
    daily = daily.groupBy(
        F.to_date("o_orderdate").alias("date"),
        _mapped(SYMBOL_OF_PRIORITY, "o_orderpriority").alias("symbol")).agg(
        half_up(80 + F.avg("o_totalprice") / 100000, 4).alias("price"))
    before = F.lag("price").over(Window.partitionBy("symbol").orderBy("date"))
    return daily.withColumn("pct_change_24h", (F.col("price") / before - 1) * 100)


def market_prices(spark: SparkSession, folder: str) -> DataFrame:
    """(date, ticker, price): the second price source."""
    lines = read_table(spark, folder, "lineitem", ["l_shipdate", "l_linenumber", "l_extendedprice"])
    ticker = F.get(F.array(*[F.lit(t) for t in TICKERS]), F.col("l_linenumber") % 3)
    return lines.groupBy(F.to_date("l_shipdate").alias("date"), ticker.alias("ticker")).agg(
        half_up(80 + F.avg("l_extendedprice") / 30000, 4).alias("price"))


def articles(spark: SparkSession, folder: str, days: int = 2400) -> DataFrame:
    """One article per document: the first line is the headline, the whole text the body.

    ``days`` is the span over which publication dates are spread.
    """
    docs = read_texts(spark, folder, "documents", ["doc_id", "text", "source"])
    day = F.date_add(F.lit("1995-01-01").cast("date"), ((F.col("doc_id") * 7) % days).cast("int"))
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"),
        F.col("text").alias("body_text"), "source", F.col("source").alias("report_name"),
        day.alias("published_at"), F.concat(F.lit("https://desk.example/"), "doc_id").alias("url"))


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """The same articles on 60 days, so that a day has many of them."""
    return articles(spark, folder, days=60)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Logged predictions, one per date and commodity, before prices are attached."""
    orders = read_table(spark, folder, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
    key = F.col("o_orderkey")
    latest = orders.groupBy(
        F.to_date("o_orderdate").alias("prediction_date"),
        _mapped(COMMODITY_OF_PRIORITY, "o_orderpriority").alias("commodity"),
        _mapped(SYMBOL_OF_PRIORITY, "o_orderpriority").alias("symbol")).agg(
        F.max(F.struct("o_orderkey", "o_custkey", "o_orderstatus")).alias("_o")).select(
        "*", "_o.*").drop("_o")
    new, old = key % 2 == 0, key % 2 == 1
    status = F.col("o_orderstatus")
    direction = (F.when((status == "O") & new, "bullish").when((status == "O") & old, "rise")
                 .when((status == "F") & new, "bearish").when((status == "F") & old, "fall")
                 .otherwise("neutral"))
    event = F.get(F.array(*[F.lit(e) for e in EVENT_NAMES]), (F.col("o_custkey") % 18).cast("int"))
    move = F.when(F.col("o_custkey") % 4 == 0, "<1%").when(F.col("o_custkey") % 4 == 1, "1-3%") \
        .otherwise(">3%")
    return latest.select(
        key.alias("id"), "prediction_date", "commodity", "symbol",
        F.when(key % 3 == 0, "HIGH").when(key % 3 == 1, "MEDIUM").otherwise("LOW").alias("signal"),
        direction.alias("direction"),
        (((key * 37) % 100).cast("double") / 100).alias("confidence"),
        move.alias("expected_move"), event.alias("event_type"),
        F.concat(F.lit("Desk note "), key.cast("string"), F.lit(" on "), "commodity",
                 F.when(key % 5 == 0, F.repeat(F.lit(" update"), 12)).otherwise("")).alias("headline"),
        F.when(key % 7 == 0, F.lit(None)).when(key % 7 < 3, "TRADE").when(key % 7 == 3, "WATCH")
        .otherwise("HOLD").alias("trade_status"))


def priced_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with stored prices, including gaps and the two classic faults.

    Some entry or exit prices are missing, some exits equal the entry, and some Brent rows carry the
    Dubai price of their day.
    """
    series = prices(spark, folder)
    window = Window.partitionBy("symbol").orderBy("date")
    after = F.when(F.datediff(F.lead("date").over(window), F.col("date")) <= 7,
                   F.lead("price").over(window))
    daily = series.select(F.col("symbol"), F.col("date").alias("prediction_date"),
                          F.col("price").alias("_entry"), after.alias("_exit"))
    dubai = series.filter("symbol = 'Dubai'").select(F.col("date").alias("prediction_date"),
                                                     F.col("price").alias("_dubai"))
    key = F.col("id")
    joined = (predictions(spark, folder).join(daily, ["symbol", "prediction_date"], "left")
              .join(dubai, "prediction_date", "left"))
    entry = F.when(key % 11 == 0, F.lit(None)).when(
        (key % 19 == 0) & (F.col("symbol") == "Brent"), F.coalesce("_dubai", "_entry")) \
        .otherwise(F.col("_entry"))
    exit_ = F.when(key % 13 == 0, F.lit(None)).when(key % 17 == 0, F.col("entry_price")) \
        .otherwise(F.col("_exit"))
    source = F.when(F.col("entry_price").isNull() | (key % 23 == 0), F.lit(None)).when(
        key % 4 == 0, fv.TIER2).otherwise(fv.TIER1)
    stop = F.when(F.col("commodity").startswith("LNG"), 2.0).otherwise(1.5)
    return (joined.withColumn("entry_price", entry).withColumn("exit_price", exit_)
            .withColumn("entry_price_source", source)
            .withColumn("cut_loss_price", trading.cut_loss_price(
                F.col("entry_price"), trading.direction(F.col("direction")), stop))
            .drop("_entry", "_exit", "_dubai"))


def settled_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with the move, outcome and P&L of the stored prices; unpriced rows stay open."""
    canonical = trading.direction(F.col("direction"))
    entry, exit_ = F.col("entry_price"), F.col("exit_price")
    move = half_up(trading.move_pct(entry, exit_), 2)
    return priced_predictions(spark, folder).withColumn("actual_move", move).withColumns({
        "outcome": trading.outcome(canonical, F.col("actual_move"), entry, F.col("cut_loss_price"), exit_),
        "pnl_usd": half_up((exit_ - entry) * fv.LOT_SIZE * trading.sign(canonical), 2),
        "impact_score": (F.col("id") % 10).cast("int"),
        "data_quality": F.when(F.col("id") % 29 == 0, "price_fetch_failed")
        .when(F.col("id") % 31 == 0, "holiday").otherwise("ok")})


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Model probabilities in long form: (article_id, model, class, p), p sums to 1 per model."""
    docs = read_table(spark, folder, "documents", ["doc_id"])
    models = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(name).alias("model"))
                       for n, name in enumerate(["general", "dubai", "embedding"])])
    classes = ["HIGH", "MEDIUM", "LOW"]
    raw = [((F.col("doc_id") * 13 + F.col("m.n") * 29 + c * 41) % 97 + 1).cast("double")
           for c in range(3)]
    total = raw[0] + raw[1] + raw[2]
    per_class = F.array(*[F.struct(F.lit(name).alias("class"), (raw[c] / total).alias("p"))
                          for c, name in enumerate(classes)])
    return (docs.withColumn("m", F.explode(models)).withColumn("c", F.explode(per_class))
            .select(F.col("doc_id").cast("string").alias("article_id"), "m.model", "c.class", "c.p"))


def scored_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Feed articles with class probabilities and a direction vote (NULL for every fifth)."""
    doc = F.col("id").cast("bigint")
    high = ((doc * 31) % 89).cast("double") / 100
    medium = (1 - high) * 0.6
    vote = F.get(F.array(F.lit("bullish"), F.lit("bearish"), F.lit("neutral")),
                 ((doc * 11) % 3).cast("int"))
    return feed(spark, folder).select(
        "id", doc.alias("seq"), "headline", F.col("published_at").alias("day"),
        high.alias("high_prob"), medium.alias("medium_prob"), (1 - high - medium).alias("low_prob"),
        F.when(doc % 5 != 0, vote).alias("direction_vote"))


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """One benchmark report text per price date, with rows of every shape and two rows to ignore."""
    series = prices(spark, folder)
    change = F.col("price") - F.lag("price").over(Window.partitionBy("symbol").orderBy("date"))

    def money(value: Column) -> Column:
        return value.cast("decimal(12,4)").cast("string")

    quoted = series.withColumn("_p", money(F.col("price"))).withColumn("_c", money(change)).withColumn(
        "_lo", money(F.col("price") - 0.02)).withColumn("_hi", money(F.col("price") + 0.02))
    row = (F.when(F.col("symbol") == "Dubai", F.concat_ws(
        " ", F.lit("Dubai (May) PCAAT00"), F.concat("_lo", F.lit("-"), "_hi"), "_p", "_c"))
        .when(F.col("symbol") == "Brent", F.concat_ws(" ", F.lit("Brent (Dated) PCAAS00"), "_p", "_c"))
        .when(F.col("symbol") == "WTI", F.concat_ws(
            " ", F.lit("WTI FOB USGC PCACG00"), F.concat("_lo", F.lit("–"), "_hi"), "_p"))
        .otherwise(F.concat_ws(" ", F.lit("Oman (May) PCABS00"), "_lo", "_hi", "_p", "_c")))
    per_date = quoted.groupBy("date").agg(*[
        F.max(F.when(F.col("symbol") == s, row)).alias(s) for s in ["Dubai", "Brent", "WTI", "Oman"]])
    text = F.concat_ws(
        "\n", F.lit("Daily oil report"), F.lit("Dubai (May) PCAAT00 1.0 2.0"), F.lit("Key benchmarks"),
        F.lit("Bid Ask Mid Change"), F.lit("Dubai swap DBDAA00 11.0 0.5"),
        F.lit("Oman spread vs Dubai PCABX00 0.75 0.1"), "Dubai", "Brent", "WTI", "Oman",
        F.lit("Dubai (Jun) PCAAU00 55.0 0.1"), F.lit("Market commentary"),
        F.lit("Supply of crude stays tight as refiners return from maintenance."),
        F.lit("Brent (Dated) PCAAS00 3.0 4.0"))
    name = F.when(F.day("date") % 3 == 0, "Crude Oil Marketwire ").when(
        F.day("date") % 3 == 1, "Arab Gulf Marketscan ").otherwise("Desk report ")
    return per_date.select(
        F.date_format("date", "yyyyMMdd").alias("id"), F.col("date").alias("published_at"),
        F.concat(name, F.date_format("date", "yyyy-MM-dd")).alias("report_name"),
        text.alias("body_text"))


def landed_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles as they land: ids that should be UUIDs, blank bodies, missing dates."""
    docs = read_texts(spark, folder, "documents", ["doc_id", "text", "n_chars"])
    digest = F.md5(F.col("doc_id").cast("string"))
    uuid = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    day = F.date_add(F.lit("1995-01-01").cast("date"), ((F.col("doc_id") * 7) % 2400).cast("int"))
    return docs.select(
        F.when(F.col("doc_id") % 7 == 0, digest).when(F.col("doc_id") % 7 == 1, F.concat(
            F.lit(" "), F.upper(uuid), F.lit("\n"))).otherwise(uuid).alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"),
        F.when(F.col("n_chars") % 3 == 0, "  \n").otherwise(F.col("text")).alias("body_text"),
        F.when(F.col("doc_id") % 11 != 0, day).alias("published_at"))


def payload_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports with an extraction payload: complete, without benchmarks, or broken JSON."""
    series = prices(spark, folder)
    per_date = series.groupBy("date").agg(
        F.max(F.when(F.col("symbol") == "Dubai", F.col("price"))).alias("dubai"),
        F.max(F.when(F.col("symbol") == "Brent", F.col("price"))).alias("brent"))

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("decimal(12,4)").cast("string"), F.lit("n/a"))

    benchmarks = F.concat(
        F.lit('[{"symbol": "Dubai (May)", "price": "1,'), number("dubai"),
        F.lit('", "change_abs": "-2.5", "evidence": " row "}, {"symbol": "brent", "price": "'),
        number("brent"), F.lit('"}, {"symbol": "Brent", "price": "9.9"}, {"symbol": "Tapis", "price": "1"}]'))
    signals = F.lit('[{"category": "Supply", "signal": " Cargo delays ", "impact": "BULLISH"}, '
                    '{"category": "", "signal": "Flat demand", "impact": "up"}, {"signal": " "}]')
    kind = F.day("date") % 3
    payload = (F.when(kind == 0, F.concat(F.lit('{"report_type": "custom", "benchmarks": '), benchmarks,
                                          F.lit(', "signals": '), signals, F.lit("}")))
               .when(kind == 1, F.concat(F.lit('{"report_date": "2000-01-01", "benchmarks": [], "signals": '),
                                         signals, F.lit("}")))
               .otherwise("no json"))
    texts = reports(spark, folder)
    from newsignal.functions.report_rows import report_type
    return texts.join(per_date, texts["published_at"] == per_date["date"]).select(
        "id", F.col("report_name").alias("file_name"), F.col("published_at").alias("report_date"),
        report_type(F.col("report_name")).alias("report_type"), "body_text", payload.alias("payload"))
