"""Vector expressions whose work grows with the length of a vector, not with its square or cube."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from rotorlake.functions.scalars import unit
from rotorlake.operators import degraded, session


def quick(df, name="x"):
    began = time.time()
    out = [r[name] for r in df.orderBy("i").collect()]
    assert time.time() - began < 30
    return out


def total(values):
    out = 0.0
    for x in values:
        out += x
    return out


def scaled(a, b, snr):
    pa, pb = total(x * x for x in a) / len(a), total(x * x for x in b) / len(b)
    if not pa or not pb:
        return None
    scale = math.sqrt(pa / (10.0 ** (snr / 10) * pb))
    out = [x + scale * y for x, y in zip(a, b)]
    top = max(map(abs, out))
    return [x * 0.99 / top for x in out] if top > 1 else out


def test_mix_works_out_its_level_and_peak_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *(rng.normal(size=(2, 600)) * (1 if i % 2 else 0.01)).tolist()) for i in range(4)] + [(4, [0.0] * 600, [1.0] * 600), (5, [1.0] * 600, [0.0] * 600), (6, None, [1.0] * 600)]
    df = spark.createDataFrame(rows, "i long, a array<double>, b array<double>").repartition(2)
    got = quick(df.select("i", degraded.mix_at_snr(F.col("a"), F.col("b"), F.lit(5.0)).alias("x")))
    assert got == [scaled(a, b, 5.0) if a else None for _, a, b in rows]
    assert max(map(abs, got[0])) < 0.5 and max(map(abs, got[1])) <= 0.991


def test_unit_works_out_its_length_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=12000).tolist()) for i in range(8)] + [(8, [0.0] * 12000), (9, None), (10, [])]
    df = spark.createDataFrame(rows, "i long, v array<double>").repartition(2)
    got = quick(df.select("i", unit(F.col("v")).alias("x")))
    for x, (_, v) in zip(got, rows):
        n = math.sqrt(total(y * y for y in v)) if v else 0.0
        assert x == (None if v is None else [y / n if n else 0.0 for y in v])


def test_a_window_is_brought_to_length_one_once(spark):
    rng = np.random.default_rng(3)
    train = [(t / np.linalg.norm(t)).tolist() for t in rng.normal(size=(40, 2000))]
    rows = [(i, rng.normal(size=2000).tolist()) for i in range(6)]
    df = spark.createDataFrame(rows, "i long, v array<double>").crossJoin(spark.createDataFrame([(train,)], "t array<array<double>>")).repartition(2)
    got = quick(df.select("i", session.knn_mean(F.col("v"), F.col("t")).alias("x")))
    for x, (_, v) in zip(got, rows):
        near = np.sort(1 - np.array(train) @ (np.array(v) / np.linalg.norm(v)))[:2]
        assert abs(x - near.mean()) < 1e-12
