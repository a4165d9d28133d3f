"""Registered queries: keyed writes, files in and out, landing formats, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsignal import schemas
from newsignal.functions.numbers import half_up
from newsignal.operators import extraction, keyed, trades
from newsignal.operators import prices as price_ops
from newsignal.operators.quality import shared_prices
from newsignal.session import shared_dir
from newsignal.sources import adapters, landing, sinks
from newsignal.sources.tables import read_table
from newsignal.streaming import ingest


def _folder(spark, name):
    """A new folder of its own in the shared directory."""
    return f"{shared_dir(spark)}/newsignal/{name}-{uuid.uuid4().hex}"


def table_scan(spark, folder):
    """Pruned scan with a pushed-down filter."""
    return read_table(spark, folder, "orders", ["o_orderkey", "o_totalprice"],
                      (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000))


def _labelled_ids(spark, folder):
    return read_table(spark, folder, "labels", ["doc_id"]).select(F.col("doc_id").cast("string").alias("id"))


def _stored_articles(spark, folder):
    return adapters.articles(spark, folder).join(_labelled_ids(spark, folder), "id", "left_semi").select(
        "id", "headline")


def _article_batch(spark, folder):
    """Every article twice, the second time as a correction that comes too late."""
    rows = adapters.articles(spark, folder).select("id", "headline")
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return twice.withColumn("headline", F.when(F.col("copy") == 2, F.concat(F.lit("late "), "headline"))
                            .otherwise(F.col("headline")))


def insert_if_absent(spark, folder):
    return keyed.insert_absent(_stored_articles(spark, folder), _article_batch(spark, folder), ["id"],
                               [F.col("copy")])


def insert_status(spark, folder):
    batch = _article_batch(spark, folder).withColumn("arrival", F.col("id").cast("bigint") * 2 + F.col("copy"))
    return keyed.insert_status(_stored_articles(spark, folder), batch, ["id"], "arrival").select(
        "id", "copy", "status")


def insert_predictions(spark, folder):
    """Every order is a candidate prediction; the first per date and commodity is inserted."""
    orders = read_table(spark, folder, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority"])
    batch = orders.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("prediction_date"),
                          adapters._mapped(adapters.COMMODITY_OF_PRIORITY, "o_orderpriority").alias("commodity"))
    stored = adapters.predictions(spark, folder).filter("trade_status = 'TRADE'")
    return keyed.insert_absent(stored, batch, ["prediction_date", "commodity"], [F.col("id")])


def _price_versions(spark, folder):
    lines = read_table(spark, folder, "lineitem",
                       ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"])
    symbol = F.get(F.array(F.lit("Dubai"), F.lit("Brent"), F.lit("LNG")), F.col("l_linenumber") % 3)
    # the test data repeats (order, line), so the price is the last tie-break
    return lines.select(F.to_date("l_shipdate").alias("date"), symbol.alias("symbol"),
                        half_up(80 + F.col("l_extendedprice") / 30000, 4).alias("price"),
                        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"))


def replace_upsert(spark, folder):
    stored = adapters.prices(spark, folder).select("date", "symbol", "price")
    out = keyed.replace_upsert(stored, _price_versions(spark, folder), ["date", "symbol"],
                               [F.col("version").desc(), F.col("price").desc()])
    return out.select("date", "symbol", "price")


def merge_nonempty(spark, folder):
    """Corrections for the labelled documents: some headlines, some bodies, many empty values."""
    stored = adapters.articles(spark, folder).select("id", "headline", F.md5("body_text").alias("body_text"), "source")
    fixes = read_table(spark, folder, "labels").groupBy(F.col("doc_id").cast("string").alias("id")).agg(
        F.max("quality").alias("q"), F.max("toxic").alias("t")).select(
        "id", F.when(F.col("q") == 1, F.concat(F.lit("Revised "), "id")).otherwise("").alias("headline"),
        F.when(F.col("t") == 1, "new body").alias("body_text"), F.lit("desk").alias("source"))
    return keyed.merge_nonempty(stored, fixes, "id", ["headline", "body_text", "source"],
                                ["headline", "body_text"])


def fill_missing(spark, folder):
    priced = adapters.priced_predictions(spark, folder)
    stored = priced.select("id", "prediction_date", "symbol", "entry_price", "exit_price")
    daily = adapters.prices(spark, folder).select(
        F.col("date").alias("prediction_date"), "symbol", F.col("price").alias("entry_price"),
        (F.col("price") + 1).alias("exit_price"))
    return keyed.fill_missing(stored, daily, ["prediction_date", "symbol"],
                              ["entry_price", "exit_price"]).select("id", "entry_price", "exit_price")


def drop_blank_keys(spark, folder):
    orders = read_table(spark, folder, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    rows = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", " \t").otherwise(
        adapters._mapped(adapters.SYMBOL_OF_PRIORITY, "o_orderpriority")).alias("symbol"))
    return keyed.drop_blank_keys(rows, "symbol")


def conform_predictions(spark, folder):
    out = schemas.conform(adapters.predictions(spark, folder), schemas.PREDICTIONS,
                          schemas.DEFAULTS["predictions"])
    return out.select("id", "prediction_date", "ticker", "price_currency", "trade_status", "entry_price",
                      "trade_number", "symbol")


def append_table(spark, folder):
    """The batch appended twice to a Parquet table; the second run adds nothing."""
    path = _folder(spark, "append")
    batch = _article_batch(spark, folder)
    for _ in range(2):
        sinks.append_absent(batch, path, ["id"], [F.col("copy")])
    return spark.read.parquet(path).select("id", "headline", "copy")


def upsert_table(spark, folder):
    """Stored prices, then new versions, in a table partitioned by symbol."""
    path = _folder(spark, "upsert")
    order = [F.col("version").desc(), F.col("price").desc()]
    stored = adapters.prices(spark, folder).select("date", "symbol", "price", F.lit(0).cast("bigint").alias("version"))
    sinks.upsert_partitions(stored, path, ["date", "symbol"], order, "symbol")
    sinks.upsert_partitions(_price_versions(spark, folder), path, ["date", "symbol"], order, "symbol")
    return spark.read.parquet(path).select("date", F.col("symbol").cast("string").alias("symbol"), "price")


def json_sink(spark, folder):
    """Extractions as JSON documents per report type, read back."""
    path = _folder(spark, "json")
    found = extraction.extract_reports(adapters.payload_reports(spark, folder))
    sinks.write_json(found, path, "report_type")
    schema = f"id string, report_date date, report_type string, benchmarks {schemas.BENCHMARKS_TYPE}, signals {schemas.SIGNALS_TYPE}"
    back = spark.read.schema(schema).json(path)
    return back.groupBy("report_type").agg(
        F.count(F.lit(1)).alias("n_reports"), F.sum(F.size("benchmarks")).alias("n_benchmarks"),
        F.sum(F.size("signals")).alias("n_signals"))


def report_directory(spark, folder):
    """Reports as text files, read back with the date in their names; the last file wins per day."""
    path = _folder(spark, "reports")
    texts = adapters.reports(spark, folder).select(F.col("report_name").alias("file_name"), "body_text")
    sinks.write_report_files(texts, path)
    files = landing.read_report_files(spark, path)
    rows = price_ops.price_rows(files.select(
        F.col("file_name").alias("id"), F.col("report_date").alias("published_at"), "body_text"))
    return price_ops.latest_per_day(rows).select("date", "symbol", "price")


def _landed_json(spark, folder):
    """One JSON document per page, in three layouts."""
    pages = read_table(spark, folder, "pages", ["page_id", "url", "html"])
    kind = F.col("page_id") % 3
    title = F.concat(F.lit(" Page "), F.col("page_id").cast("string"))
    day = F.lit("2024-02-03T04:05:06.789Z")
    full = F.to_json(F.struct(F.struct(F.struct(
        F.lit("").alias("headline"), title.alias("title"), day.alias("updatedDate"),
        F.col("url").alias("documentUrl"), F.col("html").alias("body")).alias("data")).alias("envelope")))
    packaged = F.to_json(F.struct(F.struct(
        F.struct(F.struct(F.col("html").alias("text")).alias("content")).alias("data"),
        F.struct(title.alias("title")).alias("package"),
        F.struct(day.alias("coverDate")).alias("properties")).alias("envelope"), F.col("url").alias("documentUrl")))
    flat = F.to_json(F.struct(title.alias("headline"), F.array(
        F.lit("first part"), F.lit(""), F.col("html")).alias("summary")))
    rows = pages.select(F.col("page_id").cast("string").alias("id"), F.when(kind == 0, full).when(
        kind == 1, packaged).otherwise(flat).alias("json"))
    return rows


def envelopes(spark, folder):
    """Landed JSON in three layouts to article columns."""
    return landing.normalise_envelopes(_landed_json(spark, folder))


def _landing_folder(spark, folder):
    """The documents of a folder, a document a line: every tenth is cut off, some are blank, lists, or lack an id."""
    path = _folder(spark, "landing")
    page = F.col("id").cast("bigint")
    given = F.concat(F.lit('{"id": "'), "id", F.lit('", '), F.expr("substring(json, 2)"))
    line = (F.when(page % 10 == 3, F.substring(given, 1, 20)).when(page % 10 == 5, " ").when(page % 10 == 7, F.concat(F.lit("["), given, F.lit("]")))
            .when(page % 10 == 9, F.col("json")).otherwise(given))
    _landed_json(spark, folder).select(line.alias("value")).write.text(path)
    return landing.read_documents(spark, path, lines=True)


def landing_articles(spark, folder):
    """Articles of a landing folder with unreadable documents among them."""
    return landing.normalise_documents(_landing_folder(spark, folder))


def landing_quarantine(spark, folder):
    """Documents of the folder that could not be read, by reason."""
    return landing.quarantine(_landing_folder(spark, folder)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def search_items(spark, folder):
    """Search results to articles: UUID ids, date window, fallback headlines."""
    docs = adapters.landed_articles(spark, folder).select("id", "published_at", "body_text")
    empty = F.lit("").alias
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit(""))
    dated = F.when(day != "", F.concat(day, F.lit("T10:00:00.000Z"))).otherwise("")
    items = docs.select(
        "id", dated.alias("updatedDate"), empty("publishedDate"), empty("title"),
        F.when(F.length("body_text") > 1000, " Long ").otherwise("").alias("headline"), empty("noteName"),
        F.when(F.length("body_text") > 500, "application/pdf").alias("mimeType"),
        empty("documentUrl"), F.concat(F.lit("u/"), "id").alias("url"))
    return landing.normalise_items(items, "OPEC production", "1995-06-01", "1998-06-01")


def union_sources(spark, folder):
    """Two sources, one row per id, the first source wins."""
    first = _stored_articles(spark, folder).withColumn("origin", F.lit("stored"))
    second = adapters.articles(spark, folder).select("id", "headline").withColumn("origin", F.lit("feed"))
    return keyed.union_distinct_by_id([first, second], "id").select("id", "origin")


def kept_trades(spark, folder):
    """Predictions whose id is a trade or was kept by the monthly cap."""
    priced = adapters.priced_predictions(spark, folder)
    capped = trades.monthly_cap(priced.filter("coalesce(trade_status, '') <> 'TRADE'")).filter(
        "signal = 'HIGH' and entry_price is not null").select("id")
    ids = priced.filter("trade_status = 'TRADE'").select("id").unionByName(capped)
    return priced.join(ids, "id", "left_semi").select("id", "signal", "trade_status")


def neighbour_prices(spark, folder):
    """The tolerance join with a wide tolerance, where neighbouring cells matter."""
    return shared_prices(adapters.priced_predictions(spark, folder), tolerance=0.05).select("id", "n_matches")


def stream_ingest(spark, folder):
    """Documents streamed into an article table, twice."""
    table, state = _folder(spark, "stream"), _folder(spark, "state")
    for run in range(2):
        stream = ingest.table_stream(spark, folder, "documents").select(
            F.col("doc_id").cast("string").alias("id"), "source")
        ingest.ingest(stream, table, f"{state}-{run}").awaitTermination()
    return spark.read.parquet(table)


def stream_entities(spark, folder):
    """Entities of streamed documents, the whole text taken as headline."""
    table, state = _folder(spark, "entities"), _folder(spark, "state")
    stream = ingest.table_stream(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("headline"))
    ingest.ingest_entities(stream, table, state).awaitTermination()
    return spark.read.parquet(table).select("article_id", "event_type", "region", "supply_impact",
                                            "impact_score")


def stream_daily_counts(spark, folder):
    """Events per day and type."""
    table, state = _folder(spark, "counts"), _folder(spark, "state")
    stream = ingest.table_stream(spark, folder, "events")
    ingest.count_daily(stream, table, state, "ts", "event_type").awaitTermination()
    return ingest.daily_counts(spark, table, "day date, event_type string, n bigint", "event_type")


QUERIES = {f.__name__: f for f in [
    table_scan, insert_if_absent, insert_status, insert_predictions, replace_upsert, merge_nonempty,
    fill_missing, drop_blank_keys, conform_predictions, append_table, upsert_table, json_sink,
    report_directory, envelopes, landing_articles, landing_quarantine, search_items, union_sources, kept_trades, neighbour_prices, stream_ingest,
    stream_entities, stream_daily_counts]}
