"""Parquet tables in, with column pruning and pushed-down filters left to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


_FEW_BYTES = 128 << 20


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None,
               where: Column | str | None = None) -> DataFrame:
    """Scan ``{folder}/{name}.parquet`` with only the named columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def read_texts(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan of a table whose rows are long texts and expensive to process.

    A table of at most ``_FEW_BYTES`` may be a single row group, which would keep all cores but one idle, so
    it is spread over them. A larger one is read by its row groups as it is: no shuffle of raw text.
    """
    df = read_table(spark, folder, name, columns)
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= _FEW_BYTES else df
