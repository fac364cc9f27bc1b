"""Pruned neighbours against all pairs."""

import numpy as np
import pytest

from rotorlake.operators import evidence, neighbours, scoring


def frame(spark, rows):
    return spark.createDataFrame(rows, "machine string, machine_id string, t_id long, v array<double>").repartition(5)


def brute(train, queries, k):
    out = {}
    for m, i, q, v in queries:
        u = neighbours.units(np.array([v]))[0]
        near = sorted((round(float(np.clip(1 - u @ neighbours.units(np.array([w]))[0], 0, 2)), 12), t) for a, b, t, w in train if (a, b) == (m, i))
        if near:
            out[q] = near[:k]
    return out


def clustered(rng, n, size=12, spots=20):
    centre = np.random.default_rng(1).normal(size=(spots, size))
    return (centre[rng.integers(0, spots, n)] + 0.05 * rng.normal(size=(n, size))).tolist()


def test_same_neighbours_and_few_blocks_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", 300)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(2)
    train = [("m", "a", i, v) for i, v in enumerate(clustered(rng, 900))] + [("m", "b", 5000 + i, v) for i, v in enumerate(clustered(rng, 2))]
    queries = [("m", "a", i, v) for i, v in enumerate(clustered(rng, 100))] + [("m", "b", 200, [1.0] * 12), ("m", "nobody", 201, [1.0] * 12)]
    index = neighbours.Neighbours(frame(spark, train), ["machine", "machine_id"], "t_id")
    got = {r.t_id: [(round(x.d, 12), x.t_id) for x in r.near] for r in index.search(frame(spark, queries), "t_id", 3).collect()}
    want = brute(train, queries, 3)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [t for _, t in got[q]] == [t for _, t in near] and np.allclose([d for d, _ in got[q]], [d for d, _ in near], atol=1e-11)
    n_blocks = index.blocks.where("machine_id = 'a'").count()
    compared = sum(len(r.q_ids) for r in index.chosen.where("machine_id = 'a'").collect())
    assert compared < 0.5 * 100 * n_blocks


def test_zero_vectors_and_copies(spark):
    rng = np.random.default_rng(3)
    train = [("m", "a", i, [0.0] * 4 if i % 7 == 0 else [1.0, 2.0, 0.0, 1.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(60)]
    queries = [("m", "a", i, v) for i, v in enumerate([[0.0] * 4, [1.0, 2.0, 0.0, 1.0], [-1.0, -2.0, 0.0, -1.0], *rng.normal(size=(8, 4)).tolist()])]
    got = {r.t_id: [(round(x.d, 9), x.t_id) for x in r.near] for r in neighbours.Neighbours(frame(spark, train), ["machine", "machine_id"], "t_id", pivots=3).search(frame(spark, queries), "t_id", 5).collect()}
    assert got == {q: [(round(d, 9), t) for d, t in near] for q, near in brute(train, queries, 5).items()}
    only_zero = [("m", "z", i, [0.0, 0.0]) for i in range(4)]
    got = neighbours.Neighbours(frame(spark, only_zero), ["machine", "machine_id"], "t_id").search(frame(spark, [("m", "z", 9, [1.0, 0.0])]), "t_id", 2).first()
    assert [(x.d, x.t_id) for x in got.near] == [(1.0, 0), (1.0, 1)]


def test_scores_and_guard(spark):
    rng = np.random.default_rng(5)
    rows = [("m", "a", "train" if i < 50 else "test_abnormal" if i % 2 else "test_normal", i, v) for i, v in enumerate(clustered(rng, 80, 6, 4))] + [("m", "b", "train", 100, [1.0] * 6), ("m", "b", "test_normal", 101, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "machine string, machine_id string, split string, vec_id long, v array<double>")
    a, b = ({r.vec_id: (r.y, r.score) for r in f(df).collect()} for f in (scoring.knn_scores, scoring.knn_scores_blocked))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-9 for k in a)
    with pytest.raises(ValueError, match="m b has 1 train rows"):
        scoring.knn_scores(df, strict=True)
    near = evidence.nearest_baseline(df.where("machine_id = 'b' and split <> 'train'"), df.where("split = 'train'").selectExpr("*", "cast(vec_id as double) as t"), ["machine", "machine_id"])
    assert [r.times for r in near.collect()] == [[100.0]]
