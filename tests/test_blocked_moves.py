"""The blocked scorer makes few copies of rows, however small its blocks are asked to be."""

import numpy as np

from rotorlake.operators import scoring


def test_few_pairs_of_blocks(spark, monkeypatch):
    calls, plain = spark.sparkContext.accumulator(0), scoring.nearest

    def counted(*a):
        calls.add(1)
        return plain(*a)

    rng = np.random.default_rng(3)
    rows = [("m", "a", "test_abnormal" if i % 2 else "train", i, rng.normal(size=8).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "machine string, machine_id string, split string, vec_id long, v array<double>")
    want = {r.vec_id: r.score for r in scoring.knn_scores(df).collect()}
    monkeypatch.setattr(scoring, "nearest", counted)
    got = {r.vec_id: r.score for r in scoring.knn_scores_blocked(df, block=10).collect()}
    assert got.keys() == want.keys() and all(abs(got[q] - want[q]) < 1e-9 for q in want)
    # 200 test rows in 8 blocks against 200 train rows in 2
    assert 0 < calls.value <= 16
