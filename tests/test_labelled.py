"""Labelled clips in a store, evidence lines without bands, policies from outside."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_stateful import WINDOWS, put, run

from rotorlake.functions import dsp
from rotorlake.operators import evidence, guards, session
from rotorlake.sources import labelled
from rotorlake.streaming import stateful

ROWS = "doc_id long, site_tag string, s long, sr int, samples array<float>, machine_type string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("created_at", F.timestamp_seconds("s")).drop("s")


def test_clips_under_names_of_their_own(spark, tmp_path):
    path, checks = str(tmp_path / "store"), str(tmp_path / "checks")
    wave = [0.5, -0.25, 0.9999, -1.0]
    first = frame(spark, [(k, "yard/7", 1_700_000_000, 16000, wave, "fan") for k in range(3)] + [(9, None, 1_700_000_000, 8000, [0.1] * 5, "pump")])
    a = {r.doc_id: r.stem for r in labelled.append_labelled(first, path, checks).collect()}
    assert a == {0: "20231114_221320_yard7", 1: "20231114_221320_yard7_1", 2: "20231114_221320_yard7_2", 9: "20231114_221320_unlabeled"}
    b = {r.doc_id: r.stem for r in labelled.append_labelled(frame(spark, [(20, "yard7", 1_700_000_000, 16000, [0.0], "fan"), (21, "yard7", 1_700_000_001, 16000, [0.0], "fan")]), path, checks).collect()}
    assert b == {20: "20231114_221320_yard7_3", 21: "20231114_221321_yard7"}
    held = {r.doc_id: r for r in spark.read.option("basePath", path).parquet(path).collect()}
    assert len(held) == 6 and len({r.stem for r in held.values()}) == 6
    assert np.allclose(dsp.decode_wav(bytes(held[0].wav)), wave, atol=2**-15) and (held[0].clipped, held[9].clipped, held[9].duration_s) == (True, False, 5 / 8000)
    assert json.loads(held[9].sidecar) == {"machine_type": "pump", "sr": 8000, "n_samples": 5, "created_at": "2023-11-14T22:13:20.000Z"}
    with pytest.raises(guards.GuardError) as e:
        labelled.append_labelled(frame(spark, [(30, "x", 1, 0, [0.1], "f"), (31, "x", 1, 8000, [], "f"), (32, "x", None, 8000, [0.1], "f"), (33, "x", 1, 8000, None, "f")]), path, checks)
    assert e.value.counts == {"no_samples": 2, "no_rate": 1, "no_time": 1} and spark.read.parquet(path).count() == 6


def test_evidence_without_band_or_peak(spark):
    bands = spark.createDataFrame([(1, 1, 100.0, 300.0, 4.0), (2, 1, 3000.0, 4000.0, -2.0)], "vec_id long, rank long, lo_hz double, hi_hz double, delta_db double")
    peaks = spark.createDataFrame([(2, 1, 120.4, "line hum"), (3, 1, 29.6, "1x rotation")], "vec_id long, rank long, freq_hz double, label string")
    got = {r.vec_id: r.hud for r in evidence.text(bands, peaks).collect()}
    assert got.keys() == {1, 2, 3} and got[1].endswith("vs baseline") and got[2].startswith("line hum ~120 Hz, ") and got[3] == "1x rotation ~30 Hz, anomaly vs baseline"


def test_a_policy_from_outside(spark, tmp_path):
    class Counting:
        """A policy of the caller's own: its state counts the windows."""

        def __init__(self):
            self.n = 0

        def step(self, percentile, t):
            self.n += 1
            return f"SEEN-{self.n}"

    stateful.use_rocksdb(spark)
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 1) for _ in range(3)]
    base = session.fit(spark.createDataFrame([(1, i, vec()) for i in range(20)], "stream_id long, seq long, values array<double>"))
    for k in range(2):
        put(spark.createDataFrame([(1, i, float(i), vec()) for i in range(4 * k, 4 * k + 4)], WINDOWS), tmp_path, "w")
        run(stateful.session_scores(spark.readStream.schema(WINDOWS).parquet(str(tmp_path / "w")), base, policy=Counting), tmp_path, "own")
    got = sorted((r.seq, r.state) for r in spark.read.parquet(str(tmp_path / "out-own")).collect())
    assert got == [(i, f"SEEN-{i + 1}") for i in range(8)]
