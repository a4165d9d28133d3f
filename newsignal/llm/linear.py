"""Sparse linear learners, fitted by online updates in a fixed number of shards and averaged.

A sample of at most ``bound`` labelled rows (in expectation: rows are taken by a hash of the id) is dealt
to ``shards`` groups by another hash. Each group is fitted in its own task; the weights are averaged by
Spark. The result depends neither on the partitioning nor on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal.llm.shared import bounded_share, text_pieces

_SLOTS = 1 << 20


def held_out(divisor: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; an id that is null is learnt from like any other."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == rest, F.lit(False))


def sampled(labelled: DataFrame, bound: int) -> DataFrame:
    """At most about ``bound`` rows of a frame with ``doc_id``, chosen by a hash of the id."""
    share = bounded_share(labelled.count(), bound)
    return labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(_SLOTS)) < int(share * _SLOTS) + (share == 1.0))


@dataclass
class Rows:
    """Documents of one shard as sparse rows."""
    start: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    target: np.ndarray

    def __len__(self) -> int:
        return len(self.target)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.start[i], self.start[i + 1])
        return self.feature[at], self.value[at]


Vectorise = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def rows_of(table: pa.Table, vectorise: Vectorise) -> Rows:
    """Sparse rows in the order of ``place``; ``vectorise`` gives (row, feature, value) sorted by row."""
    table = table.sort_by([("place", "ascending"), ("text", "ascending")])
    owners, features, values = [], [], []
    for first, _, data, offsets in text_pieces(table["text"].combine_chunks()):
        row, feature, value = vectorise(data, offsets)
        owners.append(row + first)
        features.append(feature.astype(np.int32))
        values.append(value.astype(np.float32))
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    start = np.searchsorted(owner, np.arange(table.num_rows + 1))
    return Rows(start, np.concatenate(features) if features else owner, np.concatenate(values) if values else owner,
                table["target"].to_numpy())


def fit(sample: DataFrame, train: Callable[[pa.Table], dict[int, tuple[np.ndarray, np.ndarray]]], shards: int,
        ) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Average over the shards of what ``train`` returns: for each output (features, weights).

    ``sample`` has doc_id, text, target. What reaches the driver is bounded by the number of features.
    """
    dealt = sample.select(
        F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard"),
        F.xxhash64("doc_id", F.lit("place")).alias("place"), F.coalesce("text", F.lit("")).alias("text"),
        F.col("target").cast("int").alias("target"))

    def run(table: pa.Table) -> pa.Table:
        found = train(table)
        return pa.table({
            "output": pa.array(np.concatenate([np.full(len(f), k) for k, (f, _) in found.items()]), pa.int32()),
            "feature": pa.array(np.concatenate([f for f, _ in found.values()]), pa.int64()),
            "weight": pa.array(np.concatenate([w for _, w in found.values()]), pa.float64())})

    weights = (dealt.groupBy("shard").applyInArrow(run, "output int, feature long, weight double")
               .groupBy("output", "feature").agg((F.sum(F.col("weight").cast("decimal(38,18)")) / shards).cast("double").alias("weight"))
               .filter("weight <> 0").toPandas())
    return {int(k): (part["feature"].to_numpy(), part["weight"].to_numpy()) for k, part in weights.groupby("output")}


def dense(part: tuple[np.ndarray, np.ndarray] | None, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.float64)
    if part is not None:
        out[part[0]] = part[1]
    return out


class Ftrl:
    """Follow-the-regularised-leader updates of a weight vector (proximal, per-coordinate rates)."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def begin(self, at: np.ndarray, weights: np.ndarray, seen: float) -> None:
        """Start from given weights, with ``seen`` as the squared gradients that led to them."""
        self.n[at] = seen
        self.z[at] = -weights * ((self.beta + np.sqrt(seen)) / self.alpha + self.l2) - np.sign(weights) * self.l1

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at, gradient: np.ndarray, weights: np.ndarray) -> None:
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = grown

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        weights = self.weights()
        at = np.flatnonzero(weights)
        return at, weights[at]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def documents_of(sample: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts of the sampled ids. The sample is broadcast: its size is bounded by its parameter."""
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(sample), "doc_id")
