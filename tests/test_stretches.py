"""Tasks step through stretches of rows, not row by row, whatever the keys and wherever batches end."""

import math

import pytest
from pyspark.sql import functions as F

from rotorlake.functions.policy import AlertPolicy
from rotorlake.operators import scan

POLICY = {"n": 2, "enter": 70.0, "leave": 40.0, "cooldown": 9.0}


@pytest.mark.parametrize("name", ["streak", "ema", "alerts"])
@pytest.mark.parametrize("slices", [1, 7])
def test_keys_that_are_no_numbers_are_one_stream_each(spark, name, slices):
    fold = {"streak": lambda: scan.Streak(70.0), "ema": scan.Smooth, "alerts": lambda: scan.Alerts(**POLICY)}[name]()
    values = [float(31 * i) % 101 for i in range(40)]
    rows = [(s, i, float(i), p) for s in (float("nan"), None, 0.0, 2.0, 3.0) for i, p in enumerate(values)]
    # both zeros are one stream
    rows = [(-0.0 if s == 0 and i % 2 else s, i, t, p) for s, i, t, p in rows]
    df = spark.createDataFrame(rows, "stream_id double, seq long, t double, percentile double").withColumn("raw", F.col("percentile"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = scan.fold_in_slices(df, "stream_id", ["seq", "t"], fold, slices).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = {}
    for r in sorted(got, key=lambda r: r.seq):
        own.setdefault("nan" if r.stream_id is not None and math.isnan(r.stream_id) else r.stream_id, []).append(r[3])
    want, a, y, k = [], AlertPolicy(**POLICY), None, 0
    for i, p in enumerate(values):
        y, k = p if y is None else 0.3 * p + 0.7 * y, k + 1 if p >= 70 else 0
        want.append({"streak": k, "ema": y, "alerts": a.step(p, float(i))}[name])
    assert own.keys() == {"nan", None, 0.0, 2.0, 3.0}
    for out in own.values():
        assert out == pytest.approx(want) if name == "ema" else out == want


def test_the_average_steps_without_a_call_for_each_row():
    fold, values = scan.Smooth(), [float(31 * i) % 101 for i in range(50)]
    want = [y for y, in fold.run(None, [(x,) for x in values])]
    fold.walk = None
    go = fold.stretches(None)
    assert [*go(values[:20])[0], *go(values[20:])[0]] == want
