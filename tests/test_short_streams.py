"""Many short streams in a few slices: only streams that slices cut are summed up, the rest is one pass."""

import pytest
from pyspark.sql import functions as F

from rotorlake.functions.policy import AlertPolicy
from rotorlake.operators import scan

POLICY = {"n": 2, "enter": 70.0, "leave": 40.0, "cooldown": 9.0}


def expected(name, values):
    if name == "alerts":
        a = AlertPolicy(**POLICY)
        return [a.step(p, float(i)) for i, p in enumerate(values)]
    out, state = [], None
    for p in values:
        state = (state or 0) * (p >= 70) + (p >= 70) if name == "streak" else p if state is None else 0.3 * p + 0.7 * state
        out.append(state)
    return out


@pytest.mark.parametrize("name", ["streak", "ema", "alerts"])
def test_whole_streams_are_not_summed_up(spark, name):
    fold = {"streak": lambda: scan.Streak(70.0), "ema": scan.Smooth, "alerts": lambda: scan.Alerts(**POLICY)}[name]()
    calls = spark.sparkContext.accumulator(0)
    plain = type(fold).summary

    def counted(rows):
        calls.add(1)
        return plain(fold, rows)

    fold.summary = counted
    values = {s: [float(7 * s + 31 * i * (s % 5 + 1)) % 101 for i in range(12)] for s in range(200)}
    rows = [(s, i, float(i), p) for s, ps in values.items() for i, p in enumerate(ps)] + [(None, i, float(i), 80.0) for i in range(12)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, t double, percentile double").withColumn("raw", F.col("percentile")).repartition(3)
    got = scan.fold_in_slices(df, "stream_id", ["seq", "t"], fold, 8)
    assert got.columns[:3] == ["stream_id", "seq", "t"]
    own = {}
    for r in sorted(got.collect(), key=lambda r: r.seq):
        own.setdefault(r.stream_id, []).append(r[3])
    assert own.keys() == {*values, None}
    for s, out in own.items():
        assert out == pytest.approx(expected(name, values.get(s, [80.0] * 12))) if name == "ema" else out == expected(name, values.get(s, [80.0] * 12))
    # 8 slices have 7 boundaries, and each cuts one stream in two
    assert calls.value <= 14
