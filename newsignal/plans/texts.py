"""Registered queries: text cleaning, training text, report tables, extraction payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsignal.functions import report_rows, text
from newsignal.operators import extraction, models, prices
from newsignal.sources import adapters
from newsignal.sources.tables import read_texts


def clean_documents(spark, folder):
    docs = read_texts(spark, folder, "documents", ["doc_id", "text"])
    return docs.select("doc_id", text.clean_report_text(F.col("text")).alias("clean_text"))


def clean_pages(spark, folder):
    pages = read_texts(spark, folder, "pages", ["page_id", "html"])
    return pages.select("page_id", text.clean_report_text(F.col("html")).alias("clean_text"))


def clean_reports(spark, folder):
    """Report texts: the table section is skipped, the commentary stays."""
    return adapters.reports(spark, folder).select("id", text.clean_report_text(F.col("body_text"))
                                                  .alias("clean_text"))


def strip_markup(spark, folder):
    pages = read_texts(spark, folder, "pages", ["page_id", "html"])
    return pages.select("page_id", text.strip_markup(F.col("html")).alias("plain"))


def narrative(spark, folder):
    docs = read_texts(spark, folder, "documents", ["doc_id", "text"])
    return docs.select("doc_id", text.extract_narrative(F.col("text")).alias("narrative"),
                       text.is_narrative_text(F.col("text")).alias("is_narrative"),
                       F.round(text.alpha_share(F.col("text")), 6).alias("alpha_share"))


def line_rules(spark, folder):
    """Counts of line kinds over all documents."""
    docs = read_texts(spark, folder, "documents", ["doc_id", "text"])
    lines = docs.select("doc_id", F.explode(text.lines_of(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line") == "").alias("n_blank"),
        F.count_if(text.is_boilerplate(F.col("line"))).alias("n_boilerplate"),
        F.count_if(text.is_price_line(F.col("line"))).alias("n_price_lines"),
        F.count_if(text.is_narrative_marker(F.col("line"))).alias("n_markers"))


def _training(rows):
    snippet = text.training_snippet(F.col("body_text"))
    return rows.withColumn("snippet", snippet).withColumn(
        "text", text.training_text(F.col("snippet"), F.col("headline")))


def training_text(spark, folder):
    return _training(adapters.articles(spark, folder)).select("id", "snippet", "text")


def training_filter(spark, folder):
    """Articles with real signal: a long snippet or a specific headline, and some text."""
    return adapters.articles(spark, folder).select(
        "id", F.inline_outer(models.usable_text(F.col("body_text"), F.col("headline")))) \
        .filter("text is not null").select("id")


def normalized_lines(spark, folder):
    return adapters.reports(spark, folder).select(
        "id", F.posexplode(text.candidate_lines(F.col("body_text"))).alias("pos", "line"))


def relevant_lines(spark, folder):
    return adapters.reports(spark, folder).select(
        "id", F.posexplode(report_rows.relevant_lines(F.col("body_text"))).alias("pos", "line"))


def benchmark_rows(spark, folder):
    rows = prices.price_rows(adapters.reports(spark, folder))
    return rows.select("id", "symbol", "label", "code", "price",
                       F.round("pct_change_24h", 6).alias("pct_change_24h"))


def quote_rows(spark, folder):
    return adapters.reports(spark, folder).select(
        "id", F.inline(report_rows.quote_rows(F.col("body_text"))))


def row_symbols(spark, folder):
    """Symbol of every table row of the reports, excluded rows included."""
    rows = adapters.reports(spark, folder).select(
        "id", F.posexplode(text.candidate_lines(F.col("body_text"))).alias("pos", "line"))
    parsed = rows.withColumn("r", report_rows.parse_row(F.col("line"))).filter("r is not null")
    return parsed.select("id", "pos", F.col("r.code").alias("code"),
                         report_rows.row_symbol(F.col("r.label"), F.col("r.code")).alias("symbol"))


def report_types(spark, folder):
    return adapters.reports(spark, folder).select(
        "id", report_rows.report_type(F.col("report_name")).alias("report_type"))


def extracted_prices(spark, folder):
    """Reports to one price per symbol and day, changes filled."""
    rows = prices.latest_per_day(prices.price_rows(adapters.reports(spark, folder)))
    return prices.fill_change(rows).select("date", "symbol", "price",
                                           F.round("pct_change_24h", 6).alias("pct_change_24h"))


def _extractions(spark, folder):
    return extraction.extract_reports(adapters.payload_reports(spark, folder))


def extraction_benchmarks(spark, folder):
    rows = _extractions(spark, folder).select("id", "report_date", "report_type", F.inline("benchmarks"))
    return rows.withColumn("pct_change_24h", F.round("pct_change_24h", 6))


def extraction_signals(spark, folder):
    return _extractions(spark, folder).select("id", F.inline("signals"))


def serialised_extractions(spark, folder):
    """Nested columns through JSON text and back."""
    stored = extraction.serialise(_extractions(spark, folder))
    back = F.from_json("signal_json", "array<struct<category:string,signal:string,impact:string>>")
    return stored.select("id", "signal_json", F.size(back).alias("n_signals"))


QUERIES = {f.__name__: f for f in [
    clean_documents, clean_pages, clean_reports, strip_markup, narrative, line_rules, training_text,
    training_filter, normalized_lines, relevant_lines, benchmark_rows, quote_rows, row_symbols,
    report_types, extracted_prices, extraction_benchmarks, extraction_signals, serialised_extractions]}
