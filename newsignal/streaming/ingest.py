"""Incremental ingestion, scoring and counting as Structured Streaming jobs.

Each job runs over what has arrived since its last run (``availableNow``) and stops. Keyed sinks are
idempotent, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from newsignal.operators.entities import extract_entities
from newsignal.sources.sinks import append_absent
from newsignal.sources.tables import read_table


def file_stream(spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet",
                files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", glob).parquet(path))


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """The files of ``{folder}/{name}.parquet`` as they arrive, whether that is one file or a folder of files.

    The braces make the path a pattern: a plain path would be taken as a base folder, which a single file is not.
    """
    schema = read_table(spark, folder, name).schema
    return file_stream(spark, f"{folder}/{{{name}}}.parquet", schema, "*", files_per_batch)


def ingest(stream: DataFrame, table: str, checkpoint: str, key: str = "id",
           transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append new rows by key. Duplicates are found against the table, so none comes too late."""

    def write(batch: DataFrame, _: int) -> None:
        append_absent(transform(batch), table, [key], [F.col(key)])

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingest_entities(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Entities of new articles; articles that have an entity row already are skipped."""
    return ingest(stream, table, checkpoint, "article_id", extract_entities)


def count_daily(stream: DataFrame, table: str, checkpoint: str, time: str, *keys: str) -> StreamingQuery:
    """Count per day, every day and every late row: each batch adds its own counts to the table.

    The table is partitioned by batch, and a batch that is repeated after a failure overwrites its own
    partition, so nothing is counted twice. :func:`daily_counts` adds the batches up.
    """
    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.to_date(time).alias("day"), *keys).agg(F.count(F.lit(1)).alias("n"))
        (counts.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table))

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def daily_counts(spark: SparkSession, table: str, schema: str, *keys: str) -> DataFrame:
    """Sum of what the batches have counted; ``schema`` declares day, keys and n."""
    return spark.read.schema(schema).parquet(table).groupBy("day", *keys).agg(F.sum("n").alias("n"))
