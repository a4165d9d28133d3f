"""What has changed in stored tables since a job last finished, so that it redoes only the partitions concerned.

A job leaves a mark: the small reference tables as it read them, the data files of its keyed table for each
partition, and its day. A mark is written after the results it speaks of. Whatever part of it is missing or
older counts as changed, so a run that ended early only does more, never less.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def partition_files(table: DataFrame, partition: str) -> DataFrame:
    """One row per partition with a digest of the names of its data files; no column is read for it."""
    files = table.select(F.col(partition).cast("string").alias("part"), F.col("_metadata.file_path").alias("file")).distinct()
    return files.groupBy("part").agg(F.count(F.lit(1)).alias("n_files"), F.bit_xor(F.xxhash64("file")).alias("digest"))


def changed_partitions(table: DataFrame, partition: str, mark: str) -> DataFrame:
    """``part`` of the partitions whose data files are others than at the mark."""
    now = partition_files(table, partition)
    before = _read(table.sparkSession, f"{mark}/files")
    return now.select("part") if before is None else now.exceptAll(before.select(*now.columns)).select("part")


def changed_days(now: DataFrame, mark: str, name: str, date: str = "date") -> DataFrame | None:
    """Days with a row that came, went or changed since the mark; None without a mark."""
    before = _read(now.sparkSession, f"{mark}/{name}")
    if before is None:
        return None
    before = before.select(*now.columns)
    return now.exceptAll(before).unionByName(before.exceptAll(now)).select(F.col(date).alias("day")).distinct()


def last_day(spark: SparkSession, mark: str):
    """Day of the marked run, None without one."""
    stored = _read(spark, f"{mark}/day")
    row = stored.first() if stored is not None else None
    return row["day"] if row else None


def set_mark(mark: str, table: DataFrame, partition: str, day, references: Mapping[str, DataFrame]) -> None:
    """Describe what a finished run has seen. The day comes last: without it nothing counts as seen."""
    spark = table.sparkSession
    for name, df in references.items():
        df.write.mode("overwrite").parquet(f"{mark}/{name}")
    partition_files(table, partition).write.mode("overwrite").parquet(f"{mark}/files")
    spark.range(1).select(F.lit(day).cast("date").alias("day")).write.mode("overwrite").parquet(f"{mark}/day")
