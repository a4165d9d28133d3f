"""A stored index of vectors with metadata: inverted lists around coarse centroids.

``{path}/centroids`` holds the centroids and ``{path}/lists`` the vectors with their metadata, partitioned by the list
of the nearest centroid. A search asks the lists of the nearest centroids of a query and ranks their rows exactly; with
``probes=None`` it asks all lists, which is the exact way. Centroids are fitted on a bounded sample (``sample`` rows,
chosen by a hash of the id); every row is indexed.

An upsert finds the lists in which its ids are stored in ``{path}/keys``, a table of (id, list) in partitions by a hash
of the id, of which only those of the batch are read. It rewrites the lists that the batch leaves or enters and nothing
else, and can be repeated. A list that loses its last row stays as an empty row, so that overwriting its partition
takes effect.

Rows whose vector is null, zero or not finite have no direction, and vectors of a rarer length than most cannot be
compared with the centroids: they are stored in list -1 and never found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from newsignal.operators.keyed import one_per_key
from newsignal.operators.similar import CELL, is_direction, nearest_in_cells, unit_rows
from newsignal.session import checkpointed

SAMPLE = 20_000
MOST_LISTS = 4096
MOST_CENTROID_VALUES = 1 << 24  # 128 MB of doubles go to every executor at most
KEY_PARTITIONS = 64
NOWHERE = -1


def default_lists(rows: int) -> int:
    """About the square root of the rows, so that a list and the list of centroids are of like size."""
    return max(1, min(MOST_LISTS, round(rows ** 0.5)))


def fit_centroids(vectors: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = 10, seed: int = 17) -> DataFrame:
    """(list, centroid): centres of a spherical k-means on ``sample`` rows."""
    rows = vectors.filter(is_direction(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    length = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.filter(F.size("embedding") == (length["size"] if length else 0))
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select(array_to_vector("embedding").alias("features"))
    chosen = checkpointed(chosen)
    spark = vectors.sparkSession
    if not chosen.head(1):
        return spark.createDataFrame([], "list int, centroid array<double>")
    fitted = KMeans(k=lists, maxIter=rounds, seed=seed, distanceMeasure="cosine", featuresCol="features").fit(chosen) if lists > 1 else None
    centres = fitted.clusterCenters() if fitted else [np.array(chosen.first()["features"].toArray())]
    return spark.createDataFrame([(k, [float(x) for x in centre]) for k, centre in enumerate(centres)], "list int, centroid array<double>")


def with_lists(vectors: DataFrame, centroids: DataFrame, probes: int = 1, out: str = "lists") -> DataFrame:
    """``vectors`` with the numbers of the ``probes`` nearest lists, nearest first; none without a direction."""
    rows = centroids.orderBy("list").collect()  # bounded by MOST_LISTS and checked below
    if sum(len(r["centroid"]) for r in rows) > MOST_CENTROID_VALUES:
        raise ValueError("too many centroids to send to every executor")
    shared = vectors.sparkSession.sparkContext.broadcast(np.array([r["centroid"] for r in rows], float))
    number = np.array([r["list"] for r in rows], np.int32)
    tagged = vectors.withColumn("_sound", is_direction(F.col("embedding")))
    names = vectors.columns
    schema = StructType([*vectors.schema.fields, StructField(out, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300) if len(centres) else centres
        for batch in batches:
            sound = np.flatnonzero(batch.column("_sound").to_numpy(zero_copy_only=False))
            column = batch.column("embedding").take(pa.array(sound))
            fit = column.value_lengths().to_numpy() == (centres.shape[1] if len(centres) else -1)
            found = np.full((batch.num_rows, min(probes, len(centres))), NOWHERE, np.int32)
            if fit.any():
                cosines = np.round(unit_rows(column.filter(pa.array(fit))) @ centres.T, 12)
                found[sound[fit]] = number[np.argsort(-cosines, axis=1, kind="stable")[:, : found.shape[1]]]
            lists = [row[row != NOWHERE].tolist() for row in found]
            kept = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lists, pa.list_(pa.int32()))], names=schema.names)

    return tagged.mapInArrow(run, schema)


def _placed(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    return with_lists(vectors, centroids).withColumn("list", F.coalesce(F.get("lists", F.lit(0)), F.lit(NOWHERE))).drop("lists")


def _key_bucket(column: str = "vec_id"):
    return F.pmod(F.xxhash64(column), F.lit(KEY_PARTITIONS)).cast("int")


def _with_empty_rows(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` and one row without an id for each of ``lists``."""
    return rows.unionByName(lists.select("list"), allowMissingColumns=True).select(rows.columns)


def build_index(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> None:
    """Write the index of ``vectors``: vec_id (one row each, not null), embedding and any metadata columns."""
    fit_centroids(vectors, lists or default_lists(vectors.count()), sample).write.mode("overwrite").parquet(f"{path}/centroids")
    centroids = vectors.sparkSession.read.parquet(f"{path}/centroids")
    placed = _placed(vectors, centroids)
    everywhere = centroids.select("list").unionByName(centroids.sparkSession.range(1).select(F.lit(NOWHERE).alias("list")))
    rows = _with_empty_rows(placed, everywhere)
    _dealt(rows).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("list").parquet(f"{path}/lists")
    keys = index_rows(vectors.sparkSession, path).select("vec_id", "list", _key_bucket().alias("bucket"))
    keys.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{path}/keys")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a list together, so that a list is few files; adaptive execution splits a large one."""
    return rows.hint("rebalance", "list")


def index_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/lists").filter("vec_id is not null")


def _keys_of(batch: DataFrame, path: str) -> DataFrame:
    """The key partitions of the ids of the batch."""
    buckets = [r[0] for r in batch.select(_key_bucket()).distinct().collect()]  # KEY_PARTITIONS at most
    return batch.sparkSession.read.parquet(f"{path}/keys").filter(F.col("bucket").isin(buckets))


def lists_of(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/centroids").count()


def touched_lists(batch: DataFrame, path: str) -> DataFrame:
    """(vec_id, list) of the stored rows with ids of the batch, from the key partitions of the batch alone."""
    return _keys_of(batch, path).join(batch.select("vec_id"), "vec_id", "left_semi").select("vec_id", "list")


def upsert_index(batch: DataFrame, path: str) -> None:
    """Insert the rows of ``batch`` or replace those of equal id: vectors and metadata.

    Of rows that repeat an id the last in the order of all their columns wins; null ids are not stored.
    """
    spark = batch.sparkSession
    stored = spark.read.parquet(f"{path}/lists")
    order = [F.col(c).desc_nulls_last() for c in batch.columns if c != "vec_id" and not isinstance(batch.schema[c].dataType, ArrayType)]
    fresh = checkpointed(_placed(one_per_key(batch.filter("vec_id is not null"), ["vec_id"], order or [F.lit(0)]),
                                 spark.read.parquet(f"{path}/centroids")))
    left = checkpointed(touched_lists(fresh, path))
    lists = [r[0] for r in left.select("list").union(fresh.select("list")).distinct().collect()]  # as many as there are lists at most
    if not lists:
        return
    kept = stored.filter(F.col("list").isin(lists) & F.col("vec_id").isNotNull()).join(fresh.select("vec_id"), "vec_id", "left_anti")
    rows = kept.select(*[c for c in stored.columns if c != "list"], "list").unionByName(fresh, allowMissingColumns=True)
    empty = spark.createDataFrame([(x,) for x in lists], "list int")
    # the new places go first, so that a run that ends between the writes finds all of them again when it is repeated
    places = fresh.select("vec_id", "list", _key_bucket().alias("bucket")).repartition("bucket")
    places.write.mode("append").partitionBy("bucket").parquet(f"{path}/keys")
    _dealt(_with_empty_rows(rows.select(stored.columns), empty)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{path}/lists")
    others = _keys_of(fresh, path).join(fresh.select("vec_id"), "vec_id", "left_anti").select("vec_id", "list", "bucket")
    others.unionByName(places).repartition("bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/keys")


def search_index(queries: DataFrame, path: str, k: int = 3, probes: int | None = 8) -> DataFrame:
    """(query_id, vec_id, score, position) of the k best rows among the ``probes`` nearest lists; exact without ``probes``.

    A list above ``CELL`` rows, such as one of many copies, is cut into cells, and the queries of the list ask each.
    """
    spark = queries.sparkSession
    rows = index_rows(spark, path)
    cells = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))  # a row per list
    cells = F.broadcast(cells)
    placed = rows.select("vec_id", "embedding", "list").join(cells, "list").withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int"))
    centroids = spark.read.parquet(f"{path}/centroids")
    asked = with_lists(queries.select("query_id", "embedding"), centroids, probes or MOST_LISTS)
    asked = asked.select("query_id", "embedding", F.explode("lists").alias("list")).join(cells, "list")
    asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return nearest_in_cells(placed, asked, ["list", "cell"], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, n_found, recall): the share of the exact neighbours that a search has found."""
    keys = ["query_id", "vec_id"]
    both = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return both.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")).select(
        "n_exact", "n_found", F.coalesce(F.try_divide("n_found", "n_exact"), F.lit(1.0)).alias("recall"))
