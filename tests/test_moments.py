"""Moments merged by blocks against exact fractions and plain NumPy."""

import time
from fractions import Fraction

import numpy as np
import pytest

from rotorlake.operators import moments, scoring


def model_of(df, keys=("k",)):
    out = {}
    for r in moments.moments(df, list(keys)).collect():
        out.setdefault(r.k, []).append(r.sums)
    return {k: moments.assembled(v) for k, v in out.items()}


@pytest.mark.parametrize("bytes_", [40, 1 << 20])
def test_moments_against_exact_fractions(spark, monkeypatch, bytes_):
    monkeypatch.setattr(moments, "BLOCK_BYTES", bytes_)
    monkeypatch.setattr(moments, "HELD_BYTES", 100)
    rng = np.random.default_rng(9)
    x = {k: 1e6 * (k + 1) + rng.integers(-1000, 1000, (n, 4)) / 8 for k, n in ((0, 200), (1, 1), (2, 37))}
    rows = [(k, v.tolist()) for k, m in x.items() for v in m]
    order = rng.permutation(len(rows))
    got = model_of(spark.createDataFrame([rows[i] for i in order], "k long, v array<double>").repartition(9))
    for k, m in x.items():
        exact = [[Fraction(float(v)) for v in r] for r in m]
        mean = [sum(c) / len(exact) for c in zip(*exact)]
        y = [[a - b for a, b in zip(r, mean)] for r in exact]
        products = np.array([[float(sum(r[i] * r[j] for r in y)) for j in range(4)] for i in range(4)])
        fourth = float(sum(sum(a * a for a in r) ** 2 for r in y))
        assert got[k].n == len(m) and np.allclose(got[k].mean, [float(a) for a in mean], rtol=1e-15)
        assert np.allclose(got[k].products, products, rtol=1e-9, atol=1e-7) and abs(got[k].fourth - fourth) <= 1e-9 * fourth + 1e-9


def test_scores_of_a_model_equal_scores_from_rows(spark):
    rng = np.random.default_rng(4)
    train, test = rng.normal(size=(40, 60)), rng.normal(size=(7, 60))
    rows = [("m", "a", "train", 100 + i, v.tolist()) for i, v in enumerate(train)] + [("m", "a", "test_normal", i, v.tolist()) for i, v in enumerate(test)]
    df = spark.createDataFrame(rows, "machine string, machine_id string, split string, vec_id long, v array<double>").repartition(5)
    got = {r.vec_id: r.score for r in scoring.mahalanobis_scores(df).collect()}
    assert np.allclose([got[i] for i in range(7)], scoring.mahalanobis(train, test), rtol=1e-9)


def test_wide_vectors_travel_as_blocks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(64, 2048))
    at = time.perf_counter()
    parts = [list(moments.blocks_of(moments.sums_of(x[i : i + 16]))) for i in range(0, 64, 16)]
    assert len(parts[0]) == 32 and max(b.products.nbytes for b in parts[0]) <= moments.BLOCK_BYTES
    merged = [sum(b[1:], b[0]) for b in map(list, zip(*parts))]
    import pickle

    m = moments.assembled([pickle.dumps(b) for b in reversed(merged)])
    y = x - x.mean(axis=0)
    assert np.allclose(m.products, y.T @ y, atol=1e-9) and np.isclose(m.fourth, ((y * y).sum(axis=1) ** 2).sum()) and time.perf_counter() - at < 60


def test_one_scan_and_no_exploded_products(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "k long, v array<double>")
    plan = moments.moments(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Generate" not in plan and plan.count("Exchange") == 2
