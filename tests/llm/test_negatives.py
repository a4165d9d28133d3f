"""Hard negatives: certain intervals, and every row against a plain version."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsignal.llm import negatives


def plain(rows, every=50, relabel=True):
    taken = []
    for vec_id, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if relabel and vec_id is not None and vec_id % 7 == 0 else label
        taken.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    out = []
    for i, (anchor, label, x) in enumerate(taken):
        if anchor is None or anchor % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), other is None, other or 0, mine == label, other) for j, (other, mine, y) in enumerate(taken)
                  if j != i and len(x) == len(y)]
        scored.sort(key=lambda s: s[:3])
        for p, _, _, same, positive in [s for s in scored if s[3]][:5]:
            fit = [s for s in scored if not s[3] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(anchor, positive, k + 1, s[4], -p, -s[0]) for k, s in enumerate(fit)]
    return sorted(out, key=repr)


def mined(frame, **how):
    rows = negatives.report(negatives.mine(negatives.coded(frame, relabel_every=7), **how)).collect()
    return sorted([tuple(r) for r in rows], key=repr)


SCHEMA = "vec_id long, label int, embedding array<float>"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 30), st.integers(0, 10**6))
def test_intervals_hold(size, n, seed):
    rng = np.random.default_rng(seed)
    rows = np.floor(256 * rng.standard_normal((n, size)) * rng.choice([0, 0.01, 1, 50], (n, 1)))
    rows[: n // 2] = np.floor(rows[-1] + rng.integers(-3, 4, (n // 2, size)))  # near ones
    block = negatives.Anchors(rows)
    low, high, _ = block.intervals(*negatives.codes(rows))
    exact = rows @ rows.T
    assert (low <= exact + 1e-6).all() and (exact <= high + 1e-6).all()
    assert (block.scores(rows) == exact.astype(np.int64)).all()


def test_intervals_filter():
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((8, 64))
    rows = np.floor(256 * (np.repeat(centre, 50, axis=0) + 0.3 * rng.standard_normal((400, 64))))
    block = negatives.Anchors(rows[:40])
    _, high, estimate = block.intervals(*negatives.codes(rows))
    first = block.own_scores(rows, negatives._best_places(estimate, 10))
    assert (high < negatives._kth(first, 5)[:, None]).mean() > 0.5  # more than half of the pairs need no score
    assert np.corrcoef(estimate.ravel(), block.scores(rows).ravel())[0, 1] > 0.9


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 48))
    assert np.allclose((negatives.rotated(x) ** 2).sum(axis=1), (x ** 2).sum(axis=1)) and negatives.rotated(x).shape == (5, 64)


@pytest.mark.parametrize("cell", [16_384, 40])
def test_against_plain_version(spark, cell):
    rng = random.Random(cell)
    centre = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = [(k, rng.randint(0, 3) if k % 3 else 1, [x / 3 + rng.gauss(0, 0.2) for x in rng.choice(centre)]) for k in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("name clash")).withColumn("size", F.lit(1)).repartition(3)
    rows = [(r[0], r[1], list(r[2])) for r in frame.select("vec_id", "label", "embedding").collect()]
    want = plain(rows)
    assert mined(frame, cell=cell) == want and len(want) > 20


def test_odd_rows(spark):
    near = [0.5, 0.5, 0.1]
    rows = [(0, 1, near), (50, None, near), (100, 2, None), (150, 2, [1.0, None, 0.0]), (200, 2, [float("nan"), 0.0, 0.0]),
            (250, 2, [float("inf"), 0.0, 0.0]), (300, 2, [0.0, 0.0, 0.0]), (350, 2, [0.4, 0.4]), (400, 2, []), (1, 2, near), (2, 2, near), (3, 2, near),
            (None, 2, [0.5, 0.45, 0.1]), (4, 3, [0.4, 0.4, 0.1]), (5, 3, [0.4, 0.4, 0.1]), (6, 3, [0.4, 0.4, 0.1]), (8, 3, [0.4, 0.4, 0.1]),
            (450, 2, near), (450, 2, near), (9, 2, [-0.5, -0.5, 0.0]), (500, 2, [3e4, 2e4, 1.0]), (10, 3, [2e4, 2e4, 1.0]), (11, 2, [3e4, 2e4, 2.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    exact = [(a, b, None if c is None else [None if x is None else float(np.float32(x)) for x in c]) for a, b, c in rows]
    assert mined(frame) == plain(exact)
    assert negatives.report(negatives.mine(negatives.coded(frame.limit(0)))).collect() == []
    assert negatives.report(negatives.mine(negatives.coded(frame.filter("vec_id < 0")))).collect() == []


def test_equal_rows_and_one_label(spark):
    rows = [(k, 1, [0.5, 0.25]) for k in range(120) if k % 7]  # ties throughout, no row of another label
    assert mined(spark.createDataFrame(rows, SCHEMA)) == []
    rows += [(1000 + k, 2, [0.4, 0.2]) for k in range(40) if (1000 + k) % 7 and (1000 + k) % 50]
    assert mined(spark.createDataFrame(rows, SCHEMA), cell=16) == plain([(a, b, [float(np.float32(x)) for x in c]) for a, b, c in rows])


def test_scores_beyond_a_long_are_an_error():
    rows = np.full((2, 4), float(1 << 40))
    with pytest.raises(OverflowError):
        negatives.Anchors(rows).scores(rows)
    rows = np.full((2, 4), float(1 << 29) + 1)
    assert negatives.Anchors(rows).scores(rows)[0, 0] == 4 * ((1 << 29) + 1) ** 2
