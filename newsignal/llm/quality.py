"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

Features are the 1- and 2-grams of tokens (runs of letters and digits, runs of other signs) hashed to
2^20 slots; the value of a slot is its share of the n-grams of the text, times a constant. Scoring is a
sparse dot product over whole Arrow batches.

Defined results: a null or empty text has no n-grams and gets the score of the intercept alone. Repeated
label rows of one document count once, with the rounded mean of their labels; null labels are ignored.
Without any labelled row every score is 0.5. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm import linear
from newsignal.llm.features import counted, word_ngrams
from newsignal.llm.shared import map_texts, sums_per_row, text_pieces


@dataclass(frozen=True)
class QualityModel:
    bits: int
    scale: float
    intercept: float
    features: np.ndarray
    weights: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for every text."""
        weights = linear.dense((self.features, self.weights), 1 << self.bits)
        parts = [np.zeros(0)]
        for first, last, data, offsets in text_pieces(texts):
            feature, row = word_ngrams(data, offsets, self.bits)
            total = np.maximum(sums_per_row(np.ones(len(row)), row, last - first), 1.0)
            parts.append(self.intercept + self.scale * sums_per_row(weights[feature], row, last - first) / total)
        return linear.sigmoid(np.concatenate(parts))


def fit(docs: DataFrame, labels: DataFrame, *, bound: int = 20_000, shards: int = 4, bits: int = 20,
        scale: float = 16.0, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01,
        ) -> QualityModel:
    """Fit on at most about ``bound`` rows of ``labels`` (doc_id, quality) that are not held out."""
    known = (labels.select("doc_id", "quality").filter("quality in (0, 1)").filter(~linear.held_out(3, 1))
             .groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("target")))
    sample = linear.documents_of(linear.sampled(known, bound), docs)

    def vectorise(data: np.ndarray, offsets: np.ndarray):
        row, feature, count = counted(*word_ngrams(data, offsets, bits), bits)
        total = np.bincount(row, weights=count, minlength=len(offsets) - 1)
        return row, feature, scale * count / total[row]

    def train(table: pa.Table):
        rows = linear.rows_of(table, vectorise)
        model, base = linear.Ftrl(1 << bits, alpha, beta, l1, l2), linear.Ftrl(1, alpha, beta, 0.0, 0.0)
        for i in range(len(rows)):
            at, x = rows.row(i)
            w, b = model.weights(at), base.weights()
            error = linear.sigmoid(w @ x + b[0]) - rows.target[i]
            model.update(at, error * x, w)
            base.update(slice(None), np.array([error]), b)
        return {0: model.sparse(), 1: base.sparse()}

    found = linear.fit(sample, train, shards)
    features, weights = found.get(0, (np.zeros(0, np.int64), np.zeros(0)))
    return QualityModel(bits, scale, float(linear.dense(found.get(1), 1)[0]), features, weights)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) of every row."""
    def work(texts: pa.Array) -> dict[str, pa.Array]:
        p = model.score(texts)
        return {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}

    scored = map_texts(docs, "score double, predicted int", work, ["doc_id"])
    return scored.select("doc_id", linear.held_out(3, 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose score reaches ``threshold``."""
    def run(batches):
        for batch in batches:
            p = model.score(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
