"""Declared tables and the projection that brings any frame to a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DateType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampType)

_TYPES = {"string": StringType(), "timestamp": TimestampType(), "date": DateType(), "double": DoubleType(),
          "int": IntegerType(), "bigint": LongType()}


def _table(**groups: str) -> StructType:
    """Fields in the order given: type name to the names of consecutive columns."""
    return StructType([StructField(name, _TYPES[kind.split("_")[0]])
                       for kind, names in groups.items() for name in names.split()])


def _joined(*parts: StructType) -> StructType:
    return StructType([field for part in parts for field in part.fields])


ARTICLES = _table(
    string="id title headline body_text source", timestamp="published_at fetched_at",
    string_2="url report_name content_id")

PRICES = _table(date="date", string="symbol", double="price pct_change_24h")

LABELLED_ARTICLES = _table(
    string="id headline body_text source", timestamp="published_at", string_2="url", date="aligned_date",
    double="price_change", string_3="label price_symbol")

ENTITIES = _table(
    string="article_id event_type region", double="sentiment", int="supply_impact impact_score",
    timestamp="extracted_at")

PREDICTIONS = _table(
    bigint="id", timestamp="logged_at", date="prediction_date",
    string="commodity ticker ticker_yf signal direction", double="confidence",
    string_2="expected_move headline", double_2="entry_price", string_3="entry_price_source",
    double_3="exit_price", string_4="exit_price_source price_currency price_unit",
    double_4="actual_move", string_5="outcome", double_5="pnl_usd", string_6="data_quality trade_status",
    int="trade_number", string_7="event_type", double_6="cut_loss_price", int_2="impact_score",
    string_8="trade_direction", double_7="return_pct", string_9="trade_outcome")

BENCHMARKS_TYPE = ("array<struct<symbol:string,price:double,change_abs:double,"
                   "pct_change_24h:double,evidence:string>>")
SIGNALS_TYPE = "array<struct<category:string,signal:string,impact:string>>"

REPORT_EXTRACTIONS = _joined(
    _table(string="id file_name", date="report_date", string_2="report_type"),
    StructType([
        StructField("benchmarks", ArrayType(_table(
            string="symbol", double="price change_abs pct_change_24h", string_2="evidence"))),
        StructField("signals", ArrayType(_table(string="category signal impact")))]),
    _table(timestamp="created_at"))

MODEL_METRICS = _table(
    string="model_type label_type", int="fold", bigint="train_size test_size",
    double="accuracy high_precision high_recall", date="train_cutoff test_end")

# values for columns that an older frame does not have yet
DEFAULTS = {
    "predictions": {"price_currency": "USD", "trade_status": "HOLD"},
    "entities": {"impact_score": 2},
}


def conform(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks (typed NULL or default); drop none."""
    defaults = defaults or {}
    present = set(df.columns)
    declared = [
        F.col(field.name).cast(field.dataType).alias(field.name) if field.name in present
        else F.lit(defaults.get(field.name)).cast(field.dataType).alias(field.name)
        for field in schema.fields
    ]
    extra = [F.col(name) for name in df.columns if name not in schema.fieldNames()]
    return df.select(*declared, *extra)
