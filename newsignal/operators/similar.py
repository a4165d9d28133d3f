"""Most similar articles by cosine similarity of embeddings: exact, in cells of rows and blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from newsignal import fixed_values as fv
from newsignal.functions.text import strip
from newsignal.operators.keyed import replace_upsert

CELL = 8192  # rows of a cell, held by one task
BLOCK = 256  # queries compared with a cell at once


def corpus_rows(labelled: DataFrame, entities: DataFrame) -> DataFrame:
    """Metadata of indexed articles: empty text instead of NULL, 0 for a missing move."""
    blank = F.lit("")
    joined = labelled.join(entities.withColumnRenamed("article_id", "id"), "id", "left")
    return joined.select(
        "id", F.substring(F.coalesce("headline", blank), 1, fv.SIMILAR_HEADLINE_CHARS).alias("headline"),
        F.coalesce(F.col("aligned_date").cast("string"), blank).alias("date"),
        F.coalesce("label", blank).alias("label"),
        F.coalesce("price_change", F.lit(0.0)).alias("price_change"),
        F.coalesce("event_type", blank).alias("event_type"), F.coalesce("region", blank).alias("region"))


def upsert_corpus(corpus: DataFrame, batch: DataFrame) -> DataFrame:
    return replace_upsert(corpus, batch, ["id"], [F.col("date").desc()])


def is_direction(vector: Column) -> Column:
    """Whether a vector has a direction: components that are all finite, not all of them zero."""
    return (vector.isNotNull() & F.exists(vector, lambda x: x != 0)
            & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row: higher scores first, then smaller columns."""
    if scores.shape[1] > k:
        bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, column = np.nonzero(scores >= bound[:, None])
    else:
        row, column = np.nonzero(np.ones(scores.shape, bool))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    start = np.searchsorted(row, np.arange(len(scores)))
    first = np.arange(len(row)) - start[row] < k
    return row[first], column[first]


def nearest_in_cells(rows: DataFrame, queries: DataFrame, cell: list[str], k: int) -> DataFrame:
    """(query_id, vec_id, score, position): the k rows of the cells of a query with the highest cosine.

    ``rows``: vec_id, embedding and the columns of ``cell``; ``queries``: query_id, embedding and a row for each cell
    it asks. A task holds the rows of one cell (a few thousand, see ``CELL``) while the queries stream through; it
    hands on k rows per query and cell. Vectors are compared with those of their length.
    """
    spark = rows.sparkSession
    ids = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("vec_id", rows.schema["vec_id"].dataType)])
    schema = StructType(ids.fields + StructType.fromDDL("score double").fields)
    place = [*cell, "_size"]
    left = rows.filter(is_direction(F.col("embedding"))).select(
        *cell, F.size("embedding").alias("_size"), F.lit(0).alias("_side"), "vec_id",
        F.lit(None).cast(ids["query_id"].dataType).alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    right = queries.filter(is_direction(F.col("embedding"))).select(
        *cell, F.size("embedding").alias("_size"), F.lit(1).alias("_side"), F.lit(None).cast(ids["vec_id"].dataType).alias("vec_id"), "query_id",
        F.col("embedding").cast("array<double>").alias("embedding"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.unionByName(right).repartition(tasks, *place).sortWithinPartitions(*place, "_side", "vec_id")
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, names, matrix = None, [], None, None
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in [*place, "_side"])))
            edges = [i for i, mark in enumerate(marks) if not i or mark != marks[i - 1]]
            for start, end in zip(edges, [*edges[1:], len(marks)]):
                *here, side = marks[start]
                if here != key:
                    key, held, names, matrix = here, [], None, None
                part = batch.slice(start, end - start)
                if side == 0:
                    held.append(part)
                    continue
                if matrix is None:
                    if not held:
                        continue  # a cell without rows
                    table = pa.Table.from_batches(held).combine_chunks()
                    names = table["vec_id"].combine_chunks()
                    matrix, held = unit_rows(table["embedding"].combine_chunks()), []
                for first in range(0, part.num_rows, BLOCK):
                    asked = part.slice(first, BLOCK)
                    # equal vectors get equal scores, whatever their place in the product
                    scores = np.round(unit_rows(asked.column("embedding")) @ matrix.T, 12)
                    row, column = _best(scores, k)
                    yield pa.RecordBatch.from_arrays(
                        [asked.column("query_id").take(pa.array(row)).cast(types[0]), names.take(pa.array(column)).cast(types[1]),
                         pa.array(scores[row, column])], names=schema.names)

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return dealt.mapInArrow(scan, schema).withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)


def askable(queries: DataFrame) -> DataFrame:
    """query_id and embedding of the queries whose text is long enough to mean something."""
    return queries.filter(F.length(strip(F.col("text"))) >= fv.SIMILAR_MIN_CHARS).select("query_id", "embedding")


def find_similar(queries: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, vec_id, similarity, position) of the k most similar corpus rows per query, exactly.

    ``queries``: query_id (one row each), text, embedding; texts under 15 characters return nothing. The corpus is
    dealt into cells by a hash of its ids, and the queries are copied to every cell: a ``CELL``-th of the pairs compared.
    """
    n = corpus.count()
    cells = max(1, -(-n // CELL), min(corpus.sparkSession.sparkContext.defaultParallelism, -(-n // 512)))
    rows = corpus.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(cells)).alias("cell"))
    asked = askable(queries).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    return nearest_in_cells(rows, asked, ["cell"], k).select("query_id", "vec_id", F.round("score", 3).alias("similarity"), "position")
