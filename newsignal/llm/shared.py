"""Helpers of the corpus operators: tables in the shared folder, Arrow columns, components of a graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.session import shared_dir


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that lineage ends there.

    The folder is named after the application; it can be removed when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that :func:`materialise` returned and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_pieces(texts: pa.Array, budget: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``budget`` UTF-8 bytes (one row at least): first row, last row + 1, bytes, offsets.

    Nulls are empty texts. Nothing is copied; what a caller derives per byte stays bounded.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first, rows = 0, len(texts)
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + budget, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def sums_per_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum of ``values`` for each row number; rows without values get 0."""
    return np.bincount(rows, weights=values, minlength=n_rows)


def append_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def map_texts(df: DataFrame, schema: str, work: Callable[[pa.Array], dict[str, pa.Array]], keep: list[str]) -> DataFrame:
    """``keep`` and what ``work`` derives from the text of each row, in Arrow batches.

    ``schema`` declares the derived columns; ``df`` needs a string column ``text``.
    """
    fields = df.select(*keep).schema.fields
    from pyspark.sql.types import StructType
    out = StructType(fields + StructType.fromDDL(schema).fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            derived = work(batch.column(batch.schema.get_field_index("text")))
            kept = [batch.column(batch.schema.get_field_index(name)) for name in keep]
            yield pa.RecordBatch.from_arrays([*kept, *derived.values()], names=[*keep, *derived])

    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, out)


def bounded_share(rows: int, bound: int) -> float:
    """Share of ``rows`` that a documented bound allows."""
    return 1.0 if rows <= bound else bound / rows


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``edges`` (a, b) of longs to (node, component), the smallest node reachable.

    Large-star / small-star rounds: every node hands its larger, then its smaller neighbours to the
    smallest one, so a chain of n links takes O(log n) rounds and each round only shuffles links. The
    neighbour minimum of a hot node is combined before the shuffle, and its links meet the minimum in an
    equality join that adaptive execution can split. Each round ends in a table in the shared folder.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialise(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = (small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionByName(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct())
        small = materialise(small)
        forget(large)
        forget(edges)
        edges, before, state = small, state, _digest(small)
        if state == before:
            break
    lows = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(lows)


def _digest(edges: DataFrame) -> tuple:
    """Number of links and a sum over their hashes: equal for equal sets of links."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def stars(node: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) of the nodes that are not the smallest themselves."""
    low: dict[int, int] = {}
    for value, tree in zip(node.tolist(), root.tolist()):
        low[tree] = min(value, low.get(tree, value))
    least = np.array([low[tree] for tree in root.tolist()], dtype=np.int64)
    other = node != least
    return node[other], least[other]


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; nulls are equal."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] = ~same.to_numpy(zero_copy_only=False)
    return out


def whole_groups(batches, keys: list[str], whole: Callable[[pa.RecordBatch], object]) -> Iterator:
    """``whole`` of runs of complete groups of a sorted stream; only the group that goes on is kept."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest:
            joint = pa.Table.from_batches([rest[-1].slice(rest[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks()
            if any(changes(joint[k].combine_chunks())[1] for k in keys):
                yield whole(joined_batches(rest))
                rest = []
        last = batch.num_rows - 1 - int(np.argmax(np.logical_or.reduce([changes(batch.column(k)) for k in keys])[::-1]))
        if last:  # a group begins inside the batch, so all before it are complete
            yield whole(joined_batches([*rest, batch.slice(0, last)]))
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield whole(joined_batches(rest))


def joined_batches(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    joined = pa.Table.from_batches(batches).combine_chunks().to_batches()
    if len(joined) > 1:  # a string column above 2 GiB
        raise MemoryError("one group holds more than 2 GiB of text in a task; raise the number of shuffle partitions")
    return joined[0] if joined else batches[0]
