"""Keys of a stored table, in partitions by a hash of the key, so that a batch reads only its own share of them.

``{path}.keys/buckets`` holds the keys of the table at ``path``, and ``{path}.keys/files`` the data files that they come
from. Before a batch is compared, the keys of files that have appeared since are added: those of the last batch, of a
batch whose run ended early, or of another writer. Adding keys twice does no harm, and the list of files is written
last, so the key table can always be caught up. If a listed file is gone (the table was rewritten), or the table has
outgrown its buckets, all keys are read anew, into as many buckets as their number asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

KEYS_PER_BUCKET = 50_000
MOST_BUCKETS = 4096
OUTGROWN = 16  # times as many keys per bucket as planned


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def buckets_for(rows: int) -> int:
    """A power of two."""
    return min(MOST_BUCKETS, 1 << max(0, -(-rows // KEYS_PER_BUCKET) - 1).bit_length())


def catch_up(spark: SparkSession, path: str, keys: Sequence[str]) -> int:
    """Add the keys of the data files that the key table does not know yet; returns its number of buckets."""
    stored = spark.read.parquet(path)
    files = set(stored.inputFiles())
    listed = _read(spark, f"{path}.keys/files")
    rows = listed.collect() if listed is not None else []  # as many as Spark lists to read the table
    known, buckets = {row["file"] for row in rows}, max((row["buckets"] for row in rows), default=0)
    if known == files:
        return buckets
    n = stored.count()  # from the footers
    anew = not buckets or bool(known - files) or buckets < MOST_BUCKETS and n > OUTGROWN * KEYS_PER_BUCKET * buckets
    new = sorted(files if anew else files - known)
    buckets = buckets_for(n) if anew else buckets
    found = spark.read.schema(stored.schema).option("basePath", path).parquet(*new) if new else stored.limit(0)
    found = found.select(*keys).distinct().withColumn("_bucket", bucket(keys, buckets))
    if anew:  # the list goes first, so that a run that ends here starts anew again
        spark.createDataFrame([], "file string, buckets int").write.mode("overwrite").parquet(f"{path}.keys/files")
    found.repartition("_bucket").write.mode("overwrite" if anew else "append").option(
        "partitionOverwriteMode", "static").partitionBy("_bucket").parquet(f"{path}.keys/buckets")
    names = spark.createDataFrame([(file, buckets) for file in new], "file string, buckets int")
    names.coalesce(1).write.mode("append").parquet(f"{path}.keys/files")
    return buckets


def known_keys(batch: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Stored keys in the buckets of the batch, after the key table has caught up."""
    buckets = catch_up(batch.sparkSession, path, keys)
    touched = [row[0] for row in batch.select(bucket(keys, buckets)).distinct().collect()]  # MOST_BUCKETS at most
    stored = batch.sparkSession.read.parquet(f"{path}.keys/buckets")
    return stored.filter(F.col("_bucket").isin(touched)).select(*keys)
