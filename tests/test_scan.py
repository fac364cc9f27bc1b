"""Long keys in slices against sequential folds and plain curves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotorlake.functions.policy import AlertPolicy
from rotorlake.operators import baseline, metrics, scan


def windows(n, seed):
    rng = random.Random(seed)
    rows, p, t = [], 50.0, 0.0
    for i in range(n):
        p = min(100.0, max(0.0, p + rng.gauss(0, 18)))
        t += rng.choice([0.0, 0.5, 1.0, 4.0])
        rows.append((1, i, t, p))
    return rows


@pytest.mark.parametrize("policy", [{"n": 3, "enter": 70.0, "leave": 30.0, "cooldown": 20.0}, {"n": 1, "enter": 60.0, "leave": 59.0, "cooldown": 0.0}, {"n": 5, "enter": 40.0, "leave": 35.0, "cooldown": 3.0}])
def test_alert_tables_compose(policy):
    for seed in range(6):
        rows = windows(300, seed)
        fold, alert = scan.Alerts(**policy), AlertPolicy(**policy)
        want = [alert.step(p, t) for _, _, t, p in rows]
        rng = random.Random(seed)
        cuts = sorted({0, 300, *(rng.randrange(300) for _ in range(40))})
        state, got = fold.start(), []
        for a, z in zip(cuts, cuts[1:]):
            part = [(p, t) for _, _, t, p in rows[a:z]]
            got += [x for x, in fold.run(state, part)]
            state = fold.after(state, fold.summary(part))
        assert got == want and (state[0], state[1]) == (alert.state, min(alert.streak, fold.n)) and (state[2] == alert.cooldown_until)


def test_one_stream_in_many_slices(spark):
    rows = windows(4000, 3) + [(s, i, float(i), 80.0) for s in (2, 3) for i in range(5)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, t double, percentile double").withColumn("raw", F.col("percentile")).repartition(6)
    policy = {"n": 2, "enter": 70.0, "leave": 40.0, "cooldown": 9.0}
    states = {(r.stream_id, r.seq): r.state for r in scan.fold_in_slices(df, "stream_id", ["seq", "t"], scan.Alerts(**policy), 64).collect()}
    ema = {(r.stream_id, r.seq): r.ema for r in scan.fold_in_slices(df, "stream_id", ["seq"], scan.Smooth(), 64).collect()}
    streaks = {(r.stream_id, r.seq): r.streak for r in scan.fold_in_slices(df, "stream_id", ["seq"], scan.Streak(70.0), 64).collect()}
    assert len(states) == len(rows)
    alert, y, k, last = None, None, 0, None
    for s, i, t, p in rows:
        if s != last:
            alert, y, k, last = AlertPolicy(**policy), None, 0, s
        y, k = p if y is None else 0.3 * p + 0.7 * y, k + 1 if p >= 70 else 0
        assert states[s, i] == alert.step(p, t) and abs(ema[s, i] - y) < 1e-9 and streaks[s, i] == k
    sliced = scan.in_slices(df, ["stream_id"], ["seq"], 64)
    assert sliced.where("stream_id = 1").select("slice").distinct().count() > 50


def test_time_going_back_between_slices_is_an_error(spark):
    df = spark.createDataFrame([(1, i, float(i if i < 50 else i - 10), 5.0) for i in range(100)], "stream_id long, seq long, t double, percentile double")
    with pytest.raises(Exception, match="time went back"):
        scan.fold_in_slices(df, "stream_id", ["seq", "t"], scan.Alerts(n=2, enter=70.0, leave=40.0, cooldown=9.0), 100).collect()


def test_running_sums_of_a_hot_key(spark):
    rng = np.random.default_rng(4)
    rows = [(1, float(x), int(c)) for x, c in zip(rng.normal(size=3000), rng.integers(0, 5, 3000))] + [(None, 1.0, 2), (None, 0.5, 3), (2, 1.0, 7)]
    df = spark.createDataFrame(rows, "k int, x double, c int")
    got = {(r.k, r.x): (r.below_c, r.all_c) for r in scan.running_sums(df, ["k"], ["x"], ["c"], 40).collect()}
    for k in (1, 2, None):
        own, total = sorted((x, c) for a, x, c in rows if a == k), 0
        for x, c in own:
            assert got[k, x] == (total, sum(c for _, c in own))
            total += c


def test_curve_and_percentile_of_one_large_id(spark):
    rng = np.random.default_rng(6)
    n = 20_000
    y, score = rng.integers(0, 2, n), np.round(rng.normal(size=n), 3)
    df = spark.createDataFrame([("m", "a", int(a), float(s)) for a, s in zip(y, score)], "machine string, machine_id string, y int, score double")
    r = metrics.metrics(df).first()
    order = np.argsort(score, kind="stable")
    values, first, counts = np.unique(score[order], return_index=True, return_counts=True)
    rank = np.empty(n)
    rank[order] = np.repeat(first + (counts + 1) / 2, counts)
    assert abs(r.auc - (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (n - y.sum()))) < 1e-12
    calib = np.round(rng.normal(size=5000), 3)
    rows = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(score)], "stream_id long, seq long, raw double")
    got = baseline.percentile_by_rank(rows, spark.createDataFrame([(1, float(c)) for c in calib], "stream_id long, raw double"), "stream_id", "raw").collect()
    assert len(got) == n and all(abs(g.percentile - 100 * (calib <= score[g.seq]).mean()) < 1e-9 for g in got)
