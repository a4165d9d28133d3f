"""Parquet and JSON out. Keyed writes touch only the partitions that the batch touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from newsignal.operators.keyed import insert_absent, replace_upsert
from newsignal.sources import key_table


def _stored(batch: DataFrame, path: str) -> DataFrame | None:
    try:
        return batch.sparkSession.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise  # a table that is there but cannot be read must not count as empty
        return None


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _touched(stored: DataFrame, batch: DataFrame, partition: str, most: int = 10_000) -> DataFrame:
    """Stored rows of the partitions that the batch touches.

    Up to ``most`` values become literals, which prune the folders that are read; more are joined.
    """
    values = [row[0] for row in batch.select(partition).distinct().limit(most + 1).collect()]
    if len(values) > most:
        return stored.join(batch.select(partition).distinct(), partition, "left_semi")
    known = F.col(partition).isin([value for value in values if value is not None])
    return stored.filter(known | F.col(partition).isNull() if None in values else known)


def _by_partition(rows: DataFrame, partition: str | None) -> DataFrame:
    """Rows of a folder side by side, so that not every task adds a file to every folder. A folder that holds much is split."""
    return rows.hint("rebalance", F.col(partition)) if partition else rows


def append_absent(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column],
                  partition: str | None = None) -> None:
    """Append the rows whose key is not stored yet; running it twice changes nothing.

    Only keys are read: those of the partitions of the batch if the partition column is one of the keys, else those of
    its buckets in the key table beside the table.
    """
    existing = _stored(batch, path)
    if existing is None:
        existing = batch.limit(0)
    elif partition in keys:
        existing = _touched(existing, batch, partition)
    else:
        existing = key_table.known_keys(batch, path, keys)
    new = insert_absent(existing, batch, keys, order)
    writer = _by_partition(new, partition).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def upsert_partitions(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column],
                      partition: str) -> None:
    """Replace rows by key inside a partitioned table.

    The partition column is one of the keys, so rows of other partitions cannot be affected: the
    stored side is pruned to the partitions of the batch, and only those are rewritten.
    """
    if partition not in keys:
        raise ValueError("the partition column must be part of the key")
    existing = _stored(batch, path)
    if existing is None:
        if not batch.head(1):
            return  # a folder without files would have no schema
        merged = replace_upsert(batch.limit(0), batch, keys, order)
    else:
        touched = _touched(existing, batch, partition)
        merged = replace_upsert(touched.select(*batch.columns), batch, keys, order)
    (_by_partition(merged, partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def write_json(df: DataFrame, path: str, partition: str) -> None:
    """JSON documents, one folder per value of the partition column."""
    df.write.mode("overwrite").partitionBy(partition).json(path)


def write_report_files(reports: DataFrame, path: str, name: str = "file_name", body: str = "body_text") -> None:
    """One folder per report name with one text file in it."""
    (reports.select(F.col(body).alias("value"), F.col(name)).repartition(F.col(name))
     .write.mode("overwrite").option("lineSep", "\n").partitionBy(name).text(path))
