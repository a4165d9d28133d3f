"""Hard negatives of anchors: rotated one-bit codes, interval filter, exact integer scores.

A vector's components become integers ``floor(scale * x)``; a score is the integer inner product. An anchor's positives
are its ``n_positive`` best other rows of the same label. The hard negatives of an anchor and a positive are the best
``n_negative`` rows of other labels whose score lies between ``low`` and ``high`` hundredths of the positive's.

*Codes.* The integer vectors are turned by random signs and Hadamard transforms (a fixed rotation), and a row keeps the
signs as a one-bit code b, its norm, and the alignment a of its direction with b. Then, for an anchor of direction q,
the cosine is a <b, q> + <r, q> with a residual r of norm sqrt(1 - a * a) that is orthogonal to b, so by Cauchy-Schwarz

    |cosine - a <b, q>| <= sqrt(1 - a * a) * sqrt(1 - <b, q> ** 2).

<b, q> is estimated by popcounts of b with the ``_PLANES`` bit planes of the quantised rotated anchor; what quantising
lost is bounded by its norm and widens the interval. The interval holds for certain, so nothing is lost: the few rows
of the best estimates <b, q> / a get their exact integer score first, which gives a threshold; then all rows whose
interval reaches it are scored exactly.

*Size.* Rows are dealt by hash into cells of at most about ``cell`` rows, whatever their labels, so no label is hot. The
anchors (a stated set of rows) are copied to every cell, stream through it in blocks and leave at most a few rows each.
Copies are a ``cell``-th of the pairs compared.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part. Vectors of
different lengths are never compared. Repeated ids are rows of their own (a row is not its own positive); ties go to the
smaller id, null ids last, then to the order of arrival. A null id is no anchor. An empty vector has score 0 with others.
Scores must fit in a long, else scoring raises ``OverflowError``. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsignal.llm.shared import materialise

_PLANES = 7
_SEED = 11
_SLACK = 1e-9
_EXACT = 1 << 53  # doubles hold integers below


def rotated(x: np.ndarray, seed: int = _SEED) -> np.ndarray:
    """Rows turned by three rounds of random signs and a Hadamard transform, padded to a power of two."""
    size = 1 << max(0, int(x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        out *= rng.integers(0, 2, size) * 2 - 1
        half = 1
        while half < size:
            pair = out.reshape(len(x), -1, 2, half)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), size)
            half *= 2
        out /= np.sqrt(size)
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """Boolean rows as 64-bit words."""
    width = -(-bits.shape[1] // 64) * 64
    full = np.zeros((len(bits), width), bool)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u8")


def codes(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words, norm and alignment of integer rows."""
    norm = np.sqrt((whole * whole).sum(axis=1))
    turned = rotated(whole / np.maximum(norm, 1e-300)[:, None])
    align = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return _packed(turned > 0), norm, np.minimum(align, 1.0)


class Anchors:
    """A block of anchors: their integers, and the bit planes of their rotated directions."""

    def __init__(self, whole: np.ndarray) -> None:
        self.whole = whole
        self.norm = np.sqrt((whole * whole).sum(axis=1))
        turned = rotated(whole / np.maximum(self.norm, 1e-300)[:, None])
        self.size = turned.shape[1]
        self.floor = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.floor) / ((1 << _PLANES) - 1), 1e-300)
        level = np.clip(np.rint((turned - self.floor[:, None]) / self.step[:, None]), 0, (1 << _PLANES) - 1).astype(np.int64)
        self.planes = [_packed((level >> k) & 1 > 0) for k in range(_PLANES)]
        held = self.floor[:, None] + level * self.step[:, None]
        self.total = held.sum(axis=1)
        self.lost = np.sqrt(((turned - held) ** 2).sum(axis=1))

    def intervals(self, words: np.ndarray, norm: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest possible score, and the estimate, of each anchor and row."""
        ones = np.zeros((len(self.whole), len(words)))
        for k, plane in enumerate(self.planes):
            both = np.zeros(ones.shape, np.int64)
            for word in range(words.shape[1]):
                both += np.bitwise_count(plane[:, word][:, None] & words[:, word][None, :])
            ones += both * float(1 << k)
        set_bits = np.bitwise_count(words).sum(axis=1)
        # the sum of the quantised anchor over the set bits, less that over the others
        along = (2 * (self.step[:, None] * ones + self.floor[:, None] * set_bits) - self.total[:, None]) / np.sqrt(self.size)
        lost = self.lost[:, None] + _SLACK
        nearest = np.maximum(np.abs(along) - lost, 0)
        half = align * lost + np.sqrt(np.maximum(1 - align * align, 0)) * np.sqrt(np.maximum(1 - nearest * nearest, 0)) + _SLACK
        scale = self.norm[:, None] * norm[None, :]
        middle = align * along
        return scale * (middle - half), scale * (middle + half), scale * along / np.maximum(align, _SLACK)

    def _doubles_are_exact(self, rows: np.ndarray) -> bool:
        """Whether every partial sum is an integer that a double holds."""
        return float(self.norm.max(initial=0)) * float(np.sqrt((rows * rows).sum(axis=-1)).max(initial=0)) < _EXACT / 2

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Exact integer scores of all anchors with ``rows``."""
        if self._doubles_are_exact(rows):
            return (self.whole @ rows.T).astype(np.int64)
        exact = self.whole.astype(np.int64).astype(object) @ rows.T.astype(np.int64).astype(object)
        if any(abs(int(x)) > np.iinfo(np.int64).max for x in exact.ravel()):
            raise OverflowError("a score does not fit in a long")
        return exact.astype(np.int64)

    def own_scores(self, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Exact scores of each anchor with its own places (anchors x few) of ``rows``."""
        if self._doubles_are_exact(rows):
            return np.einsum("ad,apd->ap", self.whole, rows[place])
        return np.take_along_axis(self.scores(rows), place, axis=1).astype(float)


def coded(vectors: DataFrame, relabel_every: int | None = None, labels: int = 10, scale: int = 256, column: str = "embedding") -> DataFrame:
    """The rows that take part: row (a number of its own), vec_id, label, size, whole (integers), words, norm, align.

    With ``relabel_every`` = n the label of ids divisible by n becomes ``(label + 1) % labels`` first: a deliberate fault
    that a mining run must cope with.
    """
    x = F.col(column)
    sound = F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = F.col("label").cast("long")
    if relabel_every:
        label = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % labels).otherwise(label)
    rows = vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.cast("array<double>").alias("x"))
    schema = "row long, vec_id long, label long, size int, whole array<double>, words array<long>, norm double, align double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("x").value_lengths().to_numpy()
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                part = batch.take(pa.array(own))
                whole = np.floor(scale * part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(own), size))
                if whole.size and np.abs(whole).max() >= _EXACT:
                    raise OverflowError("a component is too large for an exact score")
                words, norm, align = codes(whole) if size else (np.zeros((len(own), 1), "<u8"), np.zeros(len(own)), np.zeros(len(own)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + len(own))), part.column("vec_id"), part.column("label"), pa.array(np.full(len(own), size, np.int32)),
                     _listed(whole), _listed(words.view(np.int64)), pa.array(norm), pa.array(align)],
                    names=["row", "vec_id", "label", "size", "whole", "words", "norm", "align"])
                at += len(own)

    return materialise(rows.mapInArrow(run, schema))


def _listed(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix).ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


class Cell:
    """The rows of one cell and vector length, by label and then by id."""

    def __init__(self, rows: pa.Table) -> None:
        ids = rows["vec_id"].combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        value = ids.fill_null(0).to_numpy()
        label, row = rows["label"].to_numpy(), rows["row"].to_numpy()
        order = np.lexsort((row, value, ~known, label))
        self.label, self.row, self.id, self.known = label[order], row[order], value[order], known[order]
        taken = rows.take(pa.array(order)).combine_chunks()
        size = taken["size"][0].as_py()
        self.whole = _matrix(taken["whole"].combine_chunks(), size)
        words = taken["words"].combine_chunks()
        self.words = _matrix(words, len(words[0])).view("<u8")
        self.norm, self.align = taken["norm"].to_numpy(), taken["align"].to_numpy()
        # rank by (id, arrival) within the cell, the order of ties
        self.tie = np.empty(len(order), np.int64)
        self.tie[np.lexsort((self.row, self.id, ~self.known))] = np.arange(len(order))

    def same_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]).tolist())


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; minus infinity if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _best_places(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row (all, if fewer), in no order."""
    k = min(k, values.shape[1])
    return np.argpartition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k:]


def _firsts(score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one row: higher scores first, then smaller ties."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((tie[some], -score[some]))][:k]


def _best_positives(cell: Cell, rows, anchors: Anchors, k: int):
    """(anchor, place in the cell, score) of the k best other rows of the anchor's label."""
    label, own_row = rows["label"].to_numpy(), rows["row"].to_numpy()
    for value in np.unique(label).tolist():
        mine = np.flatnonzero(label == value)
        at = cell.same_label(value)
        if at.start == at.stop:
            continue
        block = Anchors(anchors.whole[mine])
        _, high, estimate = block.intervals(cell.words[at], cell.norm[at], cell.align[at])
        other = cell.row[at][None, :] != own_row[mine][:, None]
        first = _best_places(np.where(other, estimate, -np.inf), 2 * k)
        bound = _kth(np.where(np.take_along_axis(other, first, 1), block.own_scores(cell.whole[at], first), -np.inf), k)
        maybe = other & (high >= bound[:, None])
        some = np.flatnonzero(maybe.any(axis=0))
        score = block.scores(cell.whole[at][some])
        for i, anchor in enumerate(mine.tolist()):
            place = some[maybe[i, some]]
            chosen = _firsts(score[i][maybe[i, some]], cell.tie[at][place], k)
            yield anchor, place[chosen] + at.start, score[i][maybe[i, some]][chosen]


def _best_negatives(cell: Cell, rows, anchors: Anchors, k: int, low_share: int, high_share: int):
    """(anchor, number of the positive, places, scores) of the k best rows of other labels in the positive's range."""
    label = rows["label"].to_numpy()
    wanted = rows["positives"].combine_chunks() if isinstance(rows["positives"], pa.ChunkedArray) else rows["positives"]
    scores_of = [np.array(x, np.int64) for x in wanted.to_pylist()]
    least, most, estimate = anchors.intervals(cell.words, cell.norm, cell.align)
    apart = cell.label[None, :] != label[:, None]
    maybe = np.zeros(apart.shape, bool)
    n_positive = max((len(x) for x in scores_of), default=0)
    for number in range(n_positive):
        has = np.array([len(x) > number for x in scores_of])
        p = np.array([float(x[number]) if len(x) > number else 0.0 for x in scores_of])[:, None]
        bottom, top = low_share / 100 * p - 1, high_share / 100 * p + 1
        fits = apart & has[:, None] & (most >= bottom) & (least <= top)
        first = _best_places(np.where(fits & (estimate <= top), estimate, -np.inf), 4 * k)
        score = np.where(np.take_along_axis(fits, first, 1), anchors.own_scores(cell.whole, first), -np.inf)
        bound = _kth(np.where((score >= bottom + 2) & (score <= top - 2), score, -np.inf), k)  # in the range for certain
        maybe |= fits & (most >= bound[:, None])
    some = np.flatnonzero(maybe.any(axis=0))
    exact = anchors.scores(cell.whole[some])
    for i, positives in enumerate(scores_of):
        place = some[maybe[i, some]]
        score = exact[i][maybe[i, some]]
        for number, p in enumerate(positives.tolist()):
            # integer bounds: ceil(low * p / 100), floor(high * p / 100)
            inside = (score >= -(-low_share * p // 100)) & (score <= high_share * p // 100)
            if inside.any():
                chosen = _firsts(score[inside], cell.tie[place[inside]], k)
                yield i, number, place[inside][chosen], score[inside][chosen]


def _n_cells(rows: int, cell: int, parallel: int) -> int:
    """Cells of at most ``cell`` rows, and enough of them to occupy the cluster unless they would get tiny."""
    return max(1, -(-rows // cell), min(parallel, -(-rows // 1024)))


def _scan(rows: DataFrame, anchors: DataFrame, n_cells: int, schema: str, work, block: int = 256) -> DataFrame:
    """``work(cell, anchors)`` for every cell of rows and block of anchors of the same vector length."""
    own = F.pmod(F.xxhash64("row"), F.lit(n_cells)).cast("int")
    extra = [c for c in anchors.columns if c not in rows.columns]
    left = rows.select("size", own.alias("cell"), F.lit(0).alias("side"), *rows.columns[:3], "whole", "words", "norm", "align",
                       *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra])
    right = anchors.select("size", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))).alias("cell"), F.lit(1).alias("side"), *rows.columns[:3],
                           "whole", F.lit(None).cast("array<long>").alias("words"), F.lit(None).cast("double").alias("norm"),
                           F.lit(None).cast("double").alias("align"), *extra)
    place = ["size", "cell", "side"]
    dealt = left.unionByName(right).repartition(min(n_cells, 20_000), "size", "cell").sortWithinPartitions(*place)
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        held: list[pa.RecordBatch] = []
        cell, key = None, None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in place])
            edges = np.flatnonzero(np.append(True, (marks[:, 1:] != marks[:, :-1]).any(axis=0))).tolist() if batch.num_rows else []
            for start, end in zip(edges, [*edges[1:], batch.num_rows]):
                here, side = (marks[0, start], marks[1, start]), marks[2, start]
                if here != key:
                    held, cell, key = [], None, here
                part = batch.slice(start, end - start)
                if side == 0:
                    held.append(part)
                    continue
                if cell is None and held:
                    cell, held = Cell(pa.Table.from_batches(held)), []
                if cell is None:
                    continue  # a cell without rows
                for first in range(0, part.num_rows, block):
                    some = part.slice(first, block)
                    anchors_of = Anchors(_matrix(some.column("whole"), int(here[0])))
                    found = work(cell, some, anchors_of)
                    yield pa.RecordBatch.from_arrays(found, names=names)

    return dealt.mapInArrow(run, schema)


def _ids(cell: Cell, place: np.ndarray) -> pa.Array:
    return pa.array(cell.id[place], mask=~cell.known[place])


def positives(rows: DataFrame, anchors: DataFrame, n_cells: int, k: int = 5) -> DataFrame:
    """anchor_row, rank, positive_row, positive_id, score: the k best other rows of the anchors' labels."""
    def work(cell, batch, block):
        own = batch.column("row").to_numpy()
        parts = list(_best_positives(cell, batch, block, k))
        if not parts:
            return [pa.array([], pa.int64())] * 4
        place = np.concatenate([p for _, p, _ in parts])
        anchor = np.concatenate([np.full(len(p), own[i]) for i, p, _ in parts])
        return [pa.array(anchor), pa.array(cell.row[place]), _ids(cell, place), pa.array(np.concatenate([s for _, _, s in parts]))]

    found = _scan(rows, anchors, n_cells, "anchor_row long, positive_row long, positive_id long, score long", work)
    order = Window.partitionBy("anchor_row").orderBy(F.col("score").desc(), F.col("positive_id").asc_nulls_last(), "positive_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 50, n_positive: int = 5, n_negative: int = 3, low: int = 50, high: int = 95,
         cell: int = 16_384) -> DataFrame:
    """Hard negatives of the :func:`coded` rows whose id is divisible by ``every``: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score, and the rows (anchor_row, positive_row) that repeated ids need."""
    spark = rows.sparkSession
    n_cells = _n_cells(rows.count(), cell, spark.sparkContext.defaultParallelism * 2)
    anchors = rows.filter(F.col("vec_id") % every == 0).select(*rows.columns[:4], "whole")
    best = materialise(positives(rows, anchors, n_cells, n_positive))
    listed = best.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("listed"))  # n_positive at most
    asked = anchors.join(listed.select(F.col("anchor_row").alias("row"), F.col("listed.score").alias("positives")), "row").select(*anchors.columns, "positives")

    def work(cell_, batch, block):
        own = batch.column("row").to_numpy()
        parts = list(_best_negatives(cell_, batch, block, n_negative, low, high))
        if not parts:
            return [pa.array([], pa.int64()), pa.array([], pa.int32())] + [pa.array([], pa.int64())] * 3
        place = np.concatenate([p for _, _, p, _ in parts])
        anchor = np.concatenate([np.full(len(p), own[i]) for i, _, p, _ in parts])
        number = np.concatenate([np.full(len(p), n + 1, np.int32) for _, n, p, _ in parts])
        return [pa.array(anchor), pa.array(number), pa.array(cell_.row[place]), _ids(cell_, place), pa.array(np.concatenate([s for *_, s in parts]))]

    found = _scan(rows, asked, n_cells, "anchor_row long, number int, negative_row long, negative_id long, negative_score long", work)
    order = Window.partitionBy("anchor_row", "number").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), "negative_row")
    ranked = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n_negative)
    named = best.join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row").select(
        "anchor_row", "anchor_id", F.col("rank").alias("number"), "positive_row", "positive_id", F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor_row", "number"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", "anchor_row", "positive_row")


def report(mined: DataFrame) -> DataFrame:
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
with sound as (
  select row_number() over () as r, vec_id, (case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end)::bigint as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.r as a, b.r as b, a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         coalesce(list_dot_product(a.v, b.v), 0)::bigint as score
  from sound a join sound b on a.r <> b.r and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
positive as (
  select a, b, anchor_id, other_id as positive_id, score as positive_score,
         row_number() over (partition by a order by score desc, other_id nulls last, b) as k from pairs where same qualify k <= 5),
negative as (
  select p.anchor_id, p.positive_id, p.positive_score, n.other_id as negative_id, n.score as negative_score,
         row_number() over (partition by p.a, p.b order by n.score desc, n.other_id nulls last, n.b) as rank
  from positive p join pairs n on n.a = p.a and not n.same and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negative where rank <= 3
"""
