"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

A normalised vector falls, in each of ``tables`` tables, into the bucket of ``width``-quantised values of
``projections`` random projections. Only ids and a short code of signs go to the buckets. Bucket mates whose codes
differ in too many signs for the angle (five standard deviations above what the angle gives) are dropped; the others
are linked to clusters. The vector of a node is then brought to its cluster once, and all pairs of a cluster are
compared exactly, in double precision. Links are counted without listing them: a cell hands on the number of links of
each vector and one link per node, to the smallest it is connected with. Equal vectors are one node with a multiplicity.
A bucket above ``cell`` nodes, and a cluster above it, is split into chunks, and each pair of chunks is a cell.

At cosine 0.95 a pair is found with a probability of about 0.91 with the default parameters, at 0.98 and above
with more than 0.999. Nothing below ``cosine`` is ever linked.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing
and is its own component. Vectors of different lengths never link; each length is compared within itself. A null id never names a component.
Repeated rows are vectors of their own that link with each other. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm.shared import changes, components, materialise, stars, whole_groups

_BITS = 256


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal length as doubles."""
    flat = column.flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _planes(length: int, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((length, tables * projections)), rng.uniform(0.0, width, tables * projections)


def bucket_keys(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """One bucket key for each row and table: the table in the upper half of 64 bits, a hash of its cell below."""
    planes, shifts = _planes(unit.shape[1], tables, projections, width, seed)
    cells = np.floor((unit @ planes + shifts) / width).astype(np.int64).reshape(len(unit), tables, projections)
    mix = np.random.default_rng(seed + 1).integers(1, 1 << 62, projections, dtype=np.int64) | 1
    keys = (cells * mix).sum(axis=2) + unit.shape[1] * mix[0]
    return ((keys ^ (keys >> 29)) & 0xFFFFFFFF) | (np.arange(tables, dtype=np.int64) << 32)


def sign_codes(unit: np.ndarray, seed: int) -> np.ndarray:
    """``_BITS`` signs of random projections of each row, in 64-bit words."""
    planes = np.random.default_rng(seed + 2).standard_normal((unit.shape[1], _BITS))
    return np.packbits(unit @ planes > 0, axis=1).view(np.int64)


def most_signs(cosine: float) -> int:
    """Signs in which two vectors of that cosine differ at most, but for some in ten million."""
    share = np.arccos(min(cosine, 1.0)) / np.pi
    return int(np.ceil(_BITS * share + 5 * np.sqrt(_BITS * share * (1 - share))))


def classes(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, class of every row: two hashes of its components; null for vectors that link with nothing."""
    sound = (F.col(column).isNotNull() & (F.size(column) > 0)
             & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
             & F.exists(column, lambda x: x != 0))
    digest = F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(1), column, F.size(column)).alias("b"))  # 128 bits
    return vectors.select("vec_id", F.when(sound, digest).alias("class"), F.when(sound, F.col(column)).alias("vector"))


def _cells(rows: DataFrame, group: str, size: DataFrame, cell: int) -> DataFrame:
    """``rows`` with the cells (low, high) of each in its group: the pairs of its chunk with every chunk."""
    chunks = F.ceil(F.col("size") / cell).cast("int")
    split = rows.join(size, group).withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return split.select(*rows.columns, F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk")


def _edges(batch: pa.RecordBatch, place: list[str]) -> list[tuple[int, int]]:
    change = np.logical_or.reduce([changes(batch.column(c)) for c in place])
    edge = np.append(np.flatnonzero(change), batch.num_rows).tolist()
    return list(zip(edge, edge[1:]))


def clusters(nodes: DataFrame, cosine: float = 0.95, tables: int = 34, projections: int = 20, width: float = 2.0,
             seed: int = 7, cell: int = 512) -> DataFrame:
    """From nodes (node, vector): (node, component) of those that bucket mates with a like code connect."""
    def hashed(batches):
        for batch in batches:
            column = batch.column("vector")
            length = column.value_lengths().to_numpy()
            for size in np.unique(length):
                at = pa.array(np.flatnonzero(length == size))
                unit = _unit(_matrix(column.take(at)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(at), _lists(sign_codes(unit, seed)), _lists(bucket_keys(unit, tables, projections, width, seed))],
                    names=["node", "code", "keys"])

    keyed = materialise(nodes.select("node", "vector").mapInArrow(hashed, "node long, code array<long>, keys array<long>"))
    placed = keyed.select(F.explode("keys").alias("key"), "node")
    sizes = placed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    place = ["key", "low", "high"]
    whole = _cells(placed, "key", sizes, cell).join(keyed.select("node", "code"), "node")
    whole = whole.select(*place, "node", "code").repartition(*place).sortWithinPartitions(*place, "node")
    most = most_signs(cosine)

    def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
        node = batch.column("node").to_numpy()
        code = batch.column("code").flatten().to_numpy().reshape(len(node), -1)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        bounds = np.array(_edges(batch, place))
        size = bounds[:, 1] - bounds[:, 0]
        two = bounds[size == 2, 0]  # most buckets have two nodes
        hit = two[np.bitwise_count(code[two] ^ code[two + 1]).sum(axis=1) <= most]
        a.append(node[hit + 1])
        b.append(node[hit])
        for start, end in bounds[size > 2].tolist():
            own = code[start:end]
            near = sum(np.bitwise_count(own[:, None, w] ^ own[None, :, w]).astype(np.int64) for w in range(own.shape[1])) <= most
            ends = stars(*_trees(node[start:end], node[start:end], near, True))
            a.append(ends[0])
            b.append(ends[1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return components(whole.mapInArrow(lambda batches: whole_groups(batches, place, alike), "a long, b long"))


def _lists(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix).ravel()))


def linked(nodes: DataFrame, cosine: float = 0.95, cell: int = 2048, **how) -> DataFrame:
    """From nodes (node, members, vector): rows (node, other, links).

    ``links`` is the number of vectors linked with ``node`` in one cell; ``other`` is the smallest node that the
    links of the cell connect it with.
    """
    found = materialise(clusters(nodes, cosine, cell=cell, **how))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    place = ["component", "low", "high"]
    whole = _cells(found, "component", sizes, cell // 2).join(nodes, "node")
    whole = whole.select(*place, "chunk", "node", "members", "vector").repartition(*place).sortWithinPartitions(*place, "node")

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, members, chunk, low, high = (batch.column(c).to_numpy() for c in ("node", "members", "chunk", "low", "high"))
        a, b, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        vectors = batch.column("vector")
        length = vectors.value_lengths().to_numpy()
        for start, end in _edges(batch, place):
            same = low[start] == high[start]
            for size in np.unique(length[start:end]):
                own = np.flatnonzero(length[start:end] == size) + start
                x = own if same else own[chunk[own] == low[start]]
                y = own if same else own[chunk[own] == high[start]]
                if not len(x) or not len(y):
                    continue
                left = _unit(_matrix(vectors.take(pa.array(x))))
                right = left if same else _unit(_matrix(vectors.take(pa.array(y))))
                near = left @ right.T >= cosine
                if same:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                for rows, others, hit in ((x, y, near),) if same else ((x, y, near), (y, x, near.T)):
                    some = np.flatnonzero(hit.any(axis=1))
                    a.append(node[rows[some]])
                    b.append(node[rows[some]])
                    n.append((hit[some] * members[others]).sum(axis=1))
                ends = stars(*_trees(node[x], node[y], near, same))
                a.append(ends[0])
                b.append(ends[1])
                n.append(np.zeros(len(ends[0]), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in (a, b, n)], names=["node", "other", "links"])

    return whole.mapInArrow(lambda batches: whole_groups(batches, place, compared), "node long, other long, links long")


def _trees(x: np.ndarray, y: np.ndarray, near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a cell, and for each the number of the component in which the matrix puts it."""
    shift = 0 if same else len(x)
    root = np.arange(shift + len(y))
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        trees = np.unique(root[np.flatnonzero(near[i]) + shift])
        trees = trees[trees != root[i]]
        if len(trees):
            trees = np.append(trees, root[i])
            root[np.isin(root, trees)] = trees.min()
    return (x if same else np.concatenate([x, y])), root


def near_duplicates(vectors: DataFrame, column: str = "embedding", **how) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    named = materialise(classes(vectors, column).drop("vector"))
    sound = classes(vectors, column).filter("class is not null")
    groups = materialise(sound.groupBy("class").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("members"), F.first("vector").alias("vector")))
    rows = materialise(linked(groups.filter("node is not null"), **how))
    found = components(rows.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = rows.groupBy("node").agg(F.sum("links").alias("links"))
    known = groups.select("class", "node", "members").join(links, "node", "left").join(found, "node", "left").select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    component = F.coalesce("component", "vec_id")
    return named.join(known, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE = """
with recursive unit as (
  select vec_id, row_number() over () as row_no,
         case when embedding is null or len(embedding) = 0 then null
              when len([x for x in embedding if x is null or not isfinite(x)]) > 0 then null
              else [cast(x as double) for x in embedding] end as v
  from embeddings),
sound as (select row_no, vec_id, v, sqrt(list_dot_product(v, v)) as norm from unit where v is not null),
pairs as (
  select a.row_no as a, b.row_no as b from sound a join sound b on a.row_no <> b.row_no
  where a.norm > 0 and b.norm > 0 and len(a.v) = len(b.v)
    and list_dot_product(a.v, b.v) >= 0.95 * a.norm * b.norm),
reach(row_no, seen) as (
  select row_no, row_no from unit
  union
  select r.row_no, p.b from reach r join pairs p on p.a = r.seen),
named as (select r.row_no, min(u.vec_id) as component_id from reach r join unit u on u.row_no = r.seen group by r.row_no)
select u.vec_id, (select count(*) from pairs p where p.a = u.row_no) as n_links, n.component_id, u.vec_id = n.component_id as kept
from unit u join named n using (row_no)
"""
