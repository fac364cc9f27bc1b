import random

import pytest

from rotorlake.functions.policy import AlertPolicy, Capture, Ema, Throttle
from rotorlake.operators import sequence

def by_table(series, n, enter, leave, cooldown):
    """States by a table over (state, level); a level is c(old), w(arm: between the limits) or h(ot)."""
    table = {
        ("LISTENING", "c"): "LISTENING", ("LISTENING", "w"): "LISTENING", ("LISTENING", "h"): "SUSPECT",
        ("SUSPECT", "c"): "LISTENING", ("SUSPECT", "w"): "LISTENING", ("SUSPECT", "h"): "SUSPECT",
        ("ALERT", "c"): "LISTENING", ("ALERT", "w"): "ALERT", ("ALERT", "h"): "ALERT",
    }
    out, state, quiet_until = [], "LISTENING", 0.0
    for i, (t, x) in enumerate(series):
        level = "h" if x >= enter else "c" if x < leave else "w"
        new = table[state, level]
        if state == "ALERT" and new == "LISTENING":
            quiet_until = t + cooldown
        # hot windows in a row since the stream, or the last alert, began
        row = 0
        while row <= i and series[i - row][1] >= enter and (row == 0 or out[i - row] != "ALERT"):
            row += 1
        if state == "SUSPECT" and new == "SUSPECT" and row >= n and t >= quiet_until:
            new = "ALERT"
        out.append(new)
        state = new
    return out


@pytest.mark.parametrize("seed", range(8))
def test_policy_against_a_table(seed):
    rng = random.Random(seed)
    n, enter, leave, cooldown = rng.randint(1, 6), rng.choice([80.0, 99.0]), rng.choice([0.0, 40.0, 75.0]), rng.choice([0.0, 6.5, 30.0])
    t, series, hot = 0.0, [], False
    for _ in range(600):
        hot ^= rng.random() < 0.15
        t += rng.choice([0.0, 0.5, 1.0, 3.0])
        series.append((t, rng.uniform(78, 100) if hot else rng.uniform(0, 100)))
    p = AlertPolicy(n=n, enter=enter, leave=leave, cooldown=cooldown)
    got = [p.step(x, t) for t, x in series]
    assert got == by_table(series, n, enter, leave, cooldown)
    assert {"LISTENING", "SUSPECT"} <= set(got)


def test_bad_rows():
    with pytest.raises(ValueError):
        AlertPolicy().step(101, 0)
    p = AlertPolicy()
    p.step(1, 10)
    with pytest.raises(ValueError):
        p.step(1, 9)


def test_ema_throttle_capture():
    rng, e = random.Random(21), Ema(0.2)
    x = [rng.uniform(-5, 5) for _ in range(30)]
    for n, y in enumerate(e.step(v) for v in x):
        # the closed form: weights fall by 0.8 for each step back, the first value takes what is left
        assert abs(y - (0.8**n * x[0] + sum(0.2 * 0.8 ** (n - i) * x[i] for i in range(1, n + 1)))) < 1e-12
    t = Throttle()
    assert [t.step((c,), at) for c, at in (("a", 0), ("b", 0.5), ("c", 2.1), ("c", 9))] == [True, False, True, False]
    c = Capture(max_bytes=10)
    assert [c.step(n) for n in (4, 3, 8, 6)] == [True, False, False, True]


def test_fold_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(200).selectExpr("id % 3 as stream_id", "id as seq", "cast(id as double) as t", "cast(id * 37 % 101 as double) as percentile")
        got = {(r.stream_id, r.seq): r.state for r in sequence.alert_states(rows, n=2, enter=60, leave=20, cooldown=5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in range(3):
        p = AlertPolicy(n=2, enter=60, leave=20, cooldown=5)
        for i in range(s, 200, 3):
            assert got[s, i] == p.step(float(i * 37 % 101), float(i))
