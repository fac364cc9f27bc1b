"""Scoring again from degraded captures against scoring each condition by itself."""

import numpy as np
import pytest

from rotorlake.operators import degraded, metrics, scoring, splits


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(7)
    rows = [(1000 * j + k, "fan", f"id_0{j}", "abnormal" if k < 8 else "normal", f"id_0{j}/{k}.wav", (rng.normal(size=6) + (1.5 if k < 8 else 0)).tolist()) for j in range(2) for k in range(40)]
    return splits.anomaly_split(spark.createDataFrame(rows, "vec_id long, machine string, machine_id string, label string, path string, v array<double>"))


def test_conditions_equal_single_runs(spark, split):
    capture = split.where("split <> 'train'").selectExpr("path", "reverse(v) as v")
    half = capture.where("path like 'id_00%'")
    got = {(r.condition, r.scorer): r for r in degraded.rerun(split, {"reversed": capture, "half": half}, {**scoring.SCORERS, "mean": scoring.mean_scores}).collect()}
    assert len(got) == 9 and {k[0]: r.n_replaced for k, r in got.items()} == {"clean": 0, "reversed": 32, "half": 16} and all(r.n_test == 32 for r in got.values())
    for name, rows in (("clean", split), ("reversed", degraded.substitute(split, capture).drop("replaced")), ("half", degraded.substitute(split, half).drop("replaced"))):
        for scorer in ("knn", "mahalanobis"):
            m = metrics.metrics(scoring.SCORERS[scorer](rows)).toPandas()
            assert abs(got[name, scorer].auc - m["auc"].mean()) < 1e-12 and abs(got[name, scorer].pauc - m["pauc"].mean()) < 1e-12


def test_restricted_ids_and_a_capture_of_nothing(spark, split):
    ids = spark.createDataFrame([("fan", "id_01")], "machine string, machine_id string")
    capture = split.where("split <> 'train'").selectExpr("path", "reverse(v) as v")
    one = degraded.rerun(split, {"reversed": capture}, {"knn": scoring.knn_scores_blocked}, ids).collect()
    per_id = {r.machine_id: r.auc for r in metrics.auc(scoring.knn_scores_blocked(split)).collect()}
    assert {r.condition: r.n_test for r in one} == {"clean": 16, "reversed": 16} and abs(next(r.auc for r in one if r.condition == "clean") - per_id["id_01"]) < 1e-12
    with pytest.raises(Exception, match="no test clip was replaced: gone"):
        degraded.rerun(split, {"gone": capture.where("false")}, {"knn": scoring.knn_scores_blocked})
