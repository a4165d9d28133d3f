"""Toxicity: cumulative-link ordinal regression from sparse text features to an expected severity.

P(grade <= k) = sigmoid(threshold_k - w.x) for k = 0 .. grades - 2: all thresholds share the weights. The
features are lower-cased tokens and their first 4 to 7 bytes, hashed to 2^20 slots, with log(1 + count) as
value. Weights follow regularised leader updates (sparse), thresholds plain gradient steps, kept in order.

``labels.toxic`` only says 0 or 1. The grades of toxic documents are derived: a first fit with one threshold gives
each toxic document of the sample a margin, and the terciles of those margins cut grades 1, 2 and 3. The second
fit, of all weights and thresholds together, goes on from there. A label table with a column ``grade`` is used as
it is, in one fit.

Defined results: a null or empty text has no features and gets the severity of the thresholds alone. Repeated
label rows count once (their highest grade); null labels are ignored. Without labels the severity is 0. Extra
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm import linear
from newsignal.llm.features import counted, word_heads
from newsignal.llm.shared import map_texts, materialise, text_pieces


_TRUST, _NEVER = 100.0, 1e6


@dataclass(frozen=True)
class ToxicityModel:
    bits: int
    thresholds: np.ndarray  # ascending, one less than grades
    features: np.ndarray
    weights: np.ndarray

    def margins(self, texts: pa.Array) -> np.ndarray:
        """w.x of every text."""
        weights = linear.dense((self.features, self.weights), 1 << self.bits)
        used = weights != 0
        parts = [np.zeros(0)]
        for first, last, data, offsets in text_pieces(texts):
            feature, row = word_heads(data, offsets, self.bits)
            some = used[feature]
            row, feature, count = counted(feature[some], row[some], self.bits)
            parts.append(np.bincount(row, weights=weights[feature] * np.log1p(count), minlength=last - first))
        return np.concatenate(parts)

    def reached(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for every text and k."""
        return linear.sigmoid(self.margins(texts)[:, None] - self.thresholds[None, :])


def _fit(sample: DataFrame, grades: int, shards: int, bits: int, alpha: float, l1: float, l2: float, rate: float,
         epochs: int, begin: ToxicityModel | None = None) -> ToxicityModel:
    """Fit of all weights and thresholds; it goes on from ``begin``, as if that came from ``_TRUST`` earlier rows."""
    def vectorise(data: np.ndarray, offsets: np.ndarray):
        row, feature, count = counted(*word_heads(data, offsets, bits), bits)
        return row, feature, np.log1p(count)

    def train(table: pa.Table):
        rows = linear.rows_of(table, vectorise)
        model = linear.Ftrl(1 << bits, alpha, 1.0, l1, l2)
        cuts, seen = np.arange(grades - 1, dtype=float), np.full(grades - 1, 1.0)
        if begin is not None:
            model.begin(begin.features, begin.weights, _TRUST)
            cuts, seen = begin.thresholds.copy(), np.full(grades - 1, _TRUST)
        for _ in range(epochs):
            for i in range(len(rows)):
                at, x = rows.row(i)
                w = model.weights(at)
                grade, below = int(rows.target[i]), linear.sigmoid(cuts - w @ x)
                upper = below[grade] if grade < grades - 1 else 1.0
                lower = below[grade - 1] if grade else 0.0
                slope = np.zeros(grades - 1)
                likely = max(upper - lower, 1e-9)
                if grade < grades - 1:
                    slope[grade] = -upper * (1.0 - upper) / likely
                if grade:
                    slope[grade - 1] = lower * (1.0 - lower) / likely
                model.update(at, (1.0 - upper - lower) * x, w)
                seen += slope * slope
                cuts = np.maximum.accumulate(cuts - rate * slope / np.sqrt(seen) + np.arange(grades - 1) * 1e-6)
        return {0: model.sparse(), 1: (np.arange(grades - 1), cuts)}

    found = linear.fit(sample, train, shards)
    features, weights = found.get(0, (np.zeros(0, np.int64), np.zeros(0)))
    cuts = np.sort(linear.dense(found[1], grades - 1)) if 1 in found else np.full(grades - 1, _NEVER)
    return ToxicityModel(bits, cuts, features, weights)


def fit(docs: DataFrame, labels: DataFrame, *, bound: int = 16_000, shards: int = 1, bits: int = 20, grades: int = 4,
        alpha: float = 1.0, l1: float = 4.0, l2: float = 0.01, rate: float = 1.0, epochs: int = 1) -> ToxicityModel:
    """Fit on at most about ``bound`` labelled rows that are not held out, in ``shards`` tasks (toxic words are
    rare, so the few documents that have them are better learnt from in one).

    ``labels`` has doc_id and either ``grade`` (0 .. grades - 1) or ``toxic`` (0 or 1).
    """
    given = "grade" in labels.columns
    name, most = ("grade", grades - 1) if given else ("toxic", 1)
    known = (labels.select("doc_id", F.col(name).alias("target")).filter(f"target between 0 and {most}")
             .filter(~linear.held_out(3, 1)).groupBy("doc_id").agg(F.max("target").alias("target")))
    sample = materialise(linear.documents_of(linear.sampled(known, bound), docs))
    how = (shards, bits, alpha, l1, l2, rate, epochs)
    if given or grades == 2:
        return _fit(sample, grades, *how)
    first = _fit(sample, 2, *how)

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        return {"margin": pa.array(first.margins(texts))}

    rated = materialise(map_texts(sample, "margin double", work, ["doc_id", "target"]))
    steps = [k / (grades - 1) for k in range(1, grades - 1)]
    cuts = rated.filter("target = 1").agg(F.percentile("margin", F.array(*map(F.lit, steps))).alias("cuts")).first()["cuts"]
    grade = sum((F.when(F.col("margin") > cut, 1).otherwise(0) for cut in cuts or []), F.lit(1))
    rated = rated.select("doc_id", F.when(F.col("target") == 0, 0).otherwise(grade).alias("target"))
    begin = ToxicityModel(bits, np.maximum.accumulate([*first.thresholds, *(cuts or [_NEVER] * len(steps))]), first.features, first.weights)
    return _fit(sample.select("doc_id", "text").join(F.broadcast(rated.groupBy("doc_id").agg(F.max("target").alias("target"))), "doc_id"), grades, *how, begin)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, severity (expected grade), grade (most likely one), p_toxic, toxic of every row."""
    def work(texts: pa.Array) -> dict[str, pa.Array]:
        above = model.reached(texts)
        bounds = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
        return {"severity": pa.array(above.sum(axis=1)),
                "grade": pa.array((bounds[:, :-1] - bounds[:, 1:]).argmax(axis=1).astype(np.int32)),
                "p_toxic": pa.array(above[:, 0]), "toxic": pa.array(above[:, 0] >= 0.5)}

    found = map_texts(docs, "severity double, grade int, p_toxic double, toxic boolean", work, ["doc_id"])
    return found.select("doc_id", linear.held_out(3, 1).alias("held_out"), "severity", "grade", "p_toxic", "toxic")
