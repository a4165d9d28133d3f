"""Extraction payloads: validate, fall back to the rule-based rows, serialise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.functions.report_rows import (exact_symbol, first_per_symbol, parse_number,
                                             pct_from_change, quote_rows)
from newsignal.functions.text import let, strip

PAYLOAD = ("report_date string, report_type string, "
           "benchmarks array<struct<symbol:string,price:string,change_abs:string,evidence:string>>, "
           "signals array<struct<category:string,signal:string,impact:string>>")
_SYMBOLS = [symbol for symbol, _ in fv.PAYLOAD_ALIASES]


def _filled(value: Column, default: str) -> Column:
    stripped = strip(F.coalesce(value, F.lit(default)))
    return F.when(stripped == "", default).otherwise(stripped)


def valid_benchmarks(items: Column) -> Column:
    """Allowed symbols with a price, the first row per symbol, percent change derived."""

    def row(item: Column) -> Column:
        parsed = F.struct(exact_symbol(item["symbol"]).alias("symbol"),
                          parse_number(item["price"].cast("string")).alias("price"),
                          parse_number(item["change_abs"].cast("string")).alias("change_abs"),
                          strip(F.coalesce(item["evidence"], F.lit(""))).alias("evidence"))
        return let(parsed, lambda p: F.struct(
            p["symbol"].alias("symbol"), p["price"].alias("price"), p["change_abs"].alias("change_abs"),
            pct_from_change(p["price"], p["change_abs"]).alias("pct_change_24h"),
            p["evidence"].alias("evidence")))

    rows = F.filter(F.transform(items, row), lambda r: r["symbol"].isNotNull() & r["price"].isNotNull())
    return first_per_symbol(rows, _SYMBOLS)


def valid_signals(items: Column) -> Column:
    """Signals with a text; category and impact get their defaults."""

    def row(item: Column) -> Column:
        impact = F.lower(strip(F.coalesce(item["impact"], F.lit("neutral"))))
        return F.struct(_filled(item["category"], "Other").alias("category"),
                        strip(F.coalesce(item["signal"], F.lit(""))).alias("signal"),
                        F.when(impact.isin(fv.SIGNAL_IMPACTS), impact).otherwise("neutral").alias("impact"))

    return F.filter(F.transform(items, row), lambda r: r["signal"] != "")


def extract_reports(reports: DataFrame, payload: str | None = "payload") -> DataFrame:
    """Validated extraction per report (id, file_name, report_date, report_type, body_text).

    ``payload`` names a JSON column; where it is missing, broken or holds no usable benchmark, the
    bid/ask/mid/change rows of the text are used.
    """
    parsed = F.from_json(F.col(payload), PAYLOAD) if payload else F.lit(None).cast(f"struct<{_ddl()}>")
    rows = reports.withColumn("_p", parsed)
    benchmarks = valid_benchmarks(F.coalesce("_p.benchmarks", F.array().cast(
        "array<struct<symbol:string,price:string,change_abs:string,evidence:string>>")))
    by_rule = valid_benchmarks(quote_rows(F.col("body_text")))
    signals = valid_signals(F.coalesce("_p.signals", F.array().cast(
        "array<struct<category:string,signal:string,impact:string>>")))
    rows = rows.withColumn("_given", benchmarks)
    rows = rows.withColumn("benchmarks", F.when(F.size("_given") > 0, F.col("_given")).otherwise(by_rule))
    own_date = F.nullif(strip(F.coalesce("_p.report_date", F.lit(""))), F.lit(""))
    own_type = F.nullif(strip(F.coalesce("_p.report_type", F.lit(""))), F.lit(""))
    return rows.select(
        "id", "file_name", F.coalesce(own_date.try_cast("date"), "report_date").alias("report_date"),
        F.coalesce(own_type, "report_type").alias("report_type"), "benchmarks", signals.alias("signals"),
        F.length("body_text").alias("text_length"))


def _ddl() -> str:
    return ",".join(part.replace(" ", ":", 1) for part in PAYLOAD.split(", "))


def serialise(extractions: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for stores that keep them so."""
    return extractions.select(
        "id", "file_name", "report_date", "report_type", F.to_json("benchmarks").alias("benchmark_json"),
        F.to_json("signals").alias("signal_json"),
        F.to_json(F.struct("report_date", "report_type", "benchmarks", "signals")).alias("raw_json"))


def extraction_prices(extractions: DataFrame) -> DataFrame:
    """Price rows of dated extractions."""
    return extractions.filter("report_date is not null").select(
        F.col("report_date").alias("date"), F.inline("benchmarks")).select(
        "date", "symbol", "price", "pct_change_24h")
