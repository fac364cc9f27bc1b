"""Whitening against exact fractions and dense eigenvalues."""

import math

import numpy as np
import pytest

from rotorlake.llm import whitening as wh

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, n long, x string, component int"


def frame(spark, rows):
    """Vectors with extra columns whose names the operator also uses."""
    return spark.createDataFrame([(*r, 1, 5, "x", 2) for r in rows], SCHEMA).repartition(3)


def whole(vectors):
    return [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]


def check(rows, model, got, tolerance=1e-9):
    """rows: id and vector of those that take part; got: vec_id, deviation, whitened."""
    xs = whole([v for _, v in rows])
    fit = [list(t) for t in dict.fromkeys(map(tuple, xs))]
    n, p = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(p)]
    assert (model.n, model.sums) == (n, sums)
    dev = np.array([[n * x[k] - sums[k] for k in range(p)] for x in fit], object)
    v = ((dev.T @ dev) / n**3).astype(float)
    e = np.linalg.eigvalsh(v)[::-1][: len(model.values)]
    assert np.allclose(model.values, e, rtol=1e-12, atol=1e-13 * e[0])
    assert abs(v @ model.vectors - model.vectors * model.values).max() < 1e-12 * e[0]
    assert model.identity_error < 1e-9
    want = {}
    for (i, _), x in zip(rows, xs, strict=True):
        d = [n * x[k] - sums[k] for k in range(p)]
        want.setdefault(i, []).append((min(sum(a * a for a in d), wh.LONG), [sum(a / n * u for a, u in zip(d, c, strict=True)) / math.sqrt(s) for c, s in zip(model.vectors.T, model.values, strict=True)]))
    assert sum(map(len, want.values())) == len(got)
    for r in got:
        assert any(a == r.deviation and np.allclose(b, r.whitened, rtol=1e-6, atol=tolerance) for a, b in want[r.vec_id])


def run(df):
    rows = wh.whole_vectors(df)
    model = wh.fit_whitening(rows.select("x").distinct())
    return model, wh.whiten(rows, model).collect()


def test_query_has_sixteen_components_for_each_vector(spark):
    r = wh.op11_whitening(spark, SF).collect()
    source = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert len(r) == 16 * len(source) and {x.component for x in r} == set(range(1, 17))
    xs = np.array(whole([v for _, v in source]))
    v = np.cov(np.unique(xs, axis=0).T, bias=True)
    e = np.linalg.eigvalsh(v)[::-1]
    first = {x.component: x for x in r}
    assert all(abs(first[k].explained - e[k - 1] / e.sum()) < 1e-9 for k in first) and first[1].identity_error < 1e-9
    model, got = run(spark.read.parquet(f"{SF}/embeddings.parquet"))
    check(source, model, got)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 2.0, -3.0]), (2, [1.5, 0.0, 0.25]), (2, [1.5, 0.0, 0.25]), (None, [-7.0, 1.0, 1.0]), (3, [1.5, 0.0, 0.2501]), (4, [0.0, -0.0, 9.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 1.0]), (9, [1.0, -inf, 1.0]), (10, [1.0, 2.0])]
    model, got = run(frame(spark, good + bad))
    check(good, model, got)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(5, None)]])
def test_no_variance_gives_no_rows(spark, rows):
    df = wh.whole_vectors(frame(spark, rows))
    model = wh.fit_whitening(df.select("x").distinct())
    assert len(model.values) == 0 and all(r.whitened == [] for r in wh.whiten(df, model).collect())


def test_far_mean_and_huge_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    far = [(i, (1e9 + rng.integers(0, 9, 4)).tolist()) for i in range(40)]
    check(far, *run(frame(spark, far)))
    model, got = run(frame(spark, [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [5.0, -1e200])]))
    assert len(got) == 3 and max(r.deviation for r in got) == wh.LONG and model.n == 3 and np.isfinite(model.values).all()


def test_intervals_and_multiple_eigenvalues():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    for spectrum in ([5.0] * 12 + [1.0] * 18, [3.0, 2.0, 1.0] + [0.0] * 27, list(range(30)), [2 - 1e-11 * i for i in range(30)]):
        v = (q * np.array(spectrum)) @ q.T
        form = wh.tridiagonal(v)
        shifts = np.array([-0.5, 0.5, 1.5, 2.5, 4.5])
        assert wh.inertia(form, shifts).tolist() == [int((np.array(spectrum) < s).sum()) for s in shifts]
        parts = wh.intervals(v, 16)
        found = [wh.feast(v, *x) for x in parts]
        values = np.sort(np.concatenate([a for a, _ in found]))[::-1]
        vectors = np.concatenate([b for _, b in found], axis=1)
        assert len(values) == sum(x[2] for x in parts)
        assert np.allclose(values, np.sort(spectrum)[::-1][: len(values)], atol=1e-12 * max(spectrum))
        assert abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9


def test_a_wrong_inertia_count_is_refused():
    with pytest.raises(ArithmeticError):
        wh.feast(np.diag([1.0, 2.0, 3.0, 4.0]), 1.5, 3.5, 3)


def test_partial_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    fit = spark.createDataFrame([([int(a) for a in r],) for r in rng.integers(-(10**12), 10**12, (300, 5))], "x array<long>")
    n, sums, v = wh.covariance(fit.repartition(1))
    m, other, u = wh.covariance(fit.repartition(17))
    assert (n, sums) == (m, other) and (v == u).all()
