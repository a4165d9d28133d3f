"""Row numbers over a whole ordered table, without a one-task window.

A window without a partition key would pull all rows into one task, and so would a window over a key
that holds a large share of the rows. Here the rows are range-partitioned by the sort order into runs
of balanced size, fixed by a checkpoint; every run is processed on its own and the carry between
runs comes from a table with one row per run. Curves by day and whole-number id need no runs: see ``curves``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsignal.session import checkpointed


def ordered_runs(df: DataFrame, order: Sequence[str], runs: int | None = None) -> DataFrame:
    """Range-partition by ``order`` and record the partition number as column ``run``.

    Range boundaries come from a sample, so the result is materialised once: a task that is repeated
    after a lost executor then reads the same runs.
    """
    count = runs or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *[F.col(c) for c in order])
    return checkpointed(ranged.withColumn("run", F.spark_partition_id()))


def row_numbers(runs: DataFrame, out: str, order: Sequence[str]) -> DataFrame:
    """Number of the row in the whole order, from 1."""
    counts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))  # one row per run
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("run").orderBy(*order))
    return runs.join(before, "run").withColumn(out, F.col("_before") + number).drop("_before")
