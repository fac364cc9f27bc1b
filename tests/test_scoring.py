import numpy as np
import pytest
from pyspark.sql import functions as F

from rotorlake.operators import baseline, metrics, scoring, splits


def curve(y, score):
    """Points of the ROC curve, one per distinct score from the highest down."""
    cuts = np.unique(score)[::-1]
    return np.array([0.0, *(np.mean(score[y == 0] >= c) for c in cuts)]), np.array([0.0, *(np.mean(score[y == 1] >= c) for c in cuts)])


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_areas_against_a_plain_curve(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 90)
    score = np.round(rng.normal(y * 0.8, 1.0), 1)
    rows = spark.createDataFrame([("m", "a", int(a), float(s)) for a, s in zip(y, score)], "machine string, machine_id string, y int, score double")
    fpr, tpr = curve(y, score)
    part = 0.0
    for f0, f1, t0, t1 in zip(fpr[:-1], fpr[1:], tpr[:-1], tpr[1:]):
        if f0 < 0.1 and f1 > f0:
            end = min(f1, 0.1)
            part += (end - f0) * (t0 + t0 + (t1 - t0) * (end - f0) / (f1 - f0)) / 2
    r = metrics.metrics(rows).head()
    assert r.auc == pytest.approx(np.trapezoid(tpr, fpr), abs=1e-8) and r.pauc == pytest.approx(0.5 * (1 + (part - 0.005) / 0.095), abs=1e-8)


def test_all_missed_pauc(spark):
    rows = spark.createDataFrame([("m", "a", y, s) for y, s in ((0, 2.0), (0, 3.0), (1, 1.0))], "machine string, machine_id string, y int, score double")
    assert metrics.pauc(rows).head().pauc == pytest.approx(0.473684, abs=1e-5)


def test_split_is_disjoint_and_order_free(spark):
    rng = np.random.default_rng(31)
    sizes = {(f"m{k}", f"id_{k % 3}"): (int(rng.integers(1, 9)), int(rng.integers(10, 25))) for k in range(5)}
    rows = [(f"{m}-{i}-{lab}-{k}.wav", m, i, lab) for (m, i), ns in sizes.items() for lab, n in zip(("abnormal", "normal"), ns) for k in range(n)]
    schema = "path string, machine string, machine_id string, label string"
    a = splits.anomaly_split(spark.createDataFrame(rows, schema))
    b = splits.anomaly_split(spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], schema).repartition(4))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    counts = {(r.machine, r.machine_id): (r.n_train, r.n_test_normal, r.n_test_abnormal) for r in splits.split_counts(a).where("machine_id is not null").collect()}
    assert counts == {k: (good - bad, bad, bad) for k, (bad, good) in sizes.items()}
    assert all(r.n == 0 for r in splits.audit(a).collect()) and splits.split_guard(a).count() == 0
    # as many normals as abnormals leave no train clip
    few = [r for r in rows if r[3] == "abnormal" or int(r[0].rsplit("-", 1)[1].split(".")[0]) < sizes[r[1], r[2]][0]]
    assert splits.split_guard(spark.createDataFrame(few, schema)).count() == len(sizes)


def test_subset_quota(spark):
    rows = spark.createDataFrame([(f"{lab}{k:03}", "fan", "id_00", lab) for lab in ("normal", "abnormal") for k in range(90)], "path string, machine string, machine_id string, label string")
    for n in np.random.default_rng(32).integers(2, 90, 7).tolist():
        got = {r.label: r.n for r in splits.subset_quota(rows, n).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        normals = -(-7 * n // 10)
        assert got == {k: v for k, v in (("normal", normals), ("abnormal", n - normals)) if v}


def test_mahalanobis_against_plain_inverse():
    rng = np.random.default_rng(0)
    for n, p in ((40, 8), (12, 30)):
        x, z = rng.normal(size=(n, p)), rng.normal(size=(5, p))
        s, mu = scoring.shrinkage(x)
        c = x - x.mean(0)
        cov = (1 - s) * c.T @ c / n + s * mu * np.eye(p)
        d = z - x.mean(0)
        want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
        assert np.allclose(scoring.mahalanobis(x, z), want)
    with pytest.raises(ValueError):
        scoring.mahalanobis(x[:1], z)


def test_scorers_separate(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(120, 16)), rng.normal(size=(40, 16)) + 2.5])
    rows = [(i, "fan", "id_00", "train" if i < 80 else "test_normal" if i < 120 else "test_abnormal", v.tolist()) for i, v in enumerate(x)]
    split = spark.createDataFrame(rows, "vec_id long, machine string, machine_id string, split string, v array<double>")
    got = {r.scorer: r.auc for r in metrics.auc(scoring.all_scores(split), ["scorer"]).collect()}
    assert got["mahalanobis"] > 0.9 and got["knn"] > 0.6
    a = {r.vec_id: r.score for r in scoring.knn_scores(split).collect()}
    b = {r.vec_id: r.score for r in scoring.knn_scores_blocked(split, block=17).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-8 for k in a)


def test_percentile(spark):
    rng = np.random.default_rng(33)
    held, scores = np.round(rng.normal(size=17), 1), np.round(rng.normal(size=40), 1)
    calib = spark.createDataFrame([(7, held.tolist())], "stream_id long, calib array<double>")
    rows = spark.createDataFrame([(7, float(x)) for x in scores], "stream_id long, raw double")
    got = {r.raw: r.percentile for r in baseline.calib_percentile(rows, calib).collect()}
    assert all(abs(got[float(x)] - 100 * float((held <= x).mean())) < 1e-9 for x in scores)
    with pytest.raises(Exception, match="empty calibration"):
        baseline.calib_percentile(rows, spark.createDataFrame([(7, [])], "stream_id long, calib array<double>")).collect()


def test_one_path_under_two_ids_is_split_by_id(spark):
    rows = [(m, i, label, f"{label}/{k:03d}.wav", 100 * j + k) for j, (m, i) in enumerate([("fan", "id_00"), ("pump", "id_00"), ("fan", "id_02")]) for label, ks in (("abnormal", range(3 + j)), ("normal", range(10, 30))) for k in ks]
    clips = spark.createDataFrame(rows, "machine string, machine_id string, label string, path string, vec_id long")
    got = splits.anomaly_split(clips).collect()
    assert len(got) == len(rows) and {r.vec_id for r in got} == {r[4] for r in rows}
    for j, (m, i) in enumerate([("fan", "id_00"), ("pump", "id_00"), ("fan", "id_02")]):
        sides = [r.split for r in got if (r.machine, r.machine_id) == (m, i)]
        assert (sides.count("test_abnormal"), sides.count("test_normal"), sides.count("train")) == (3 + j, 3 + j, 17 - j)


@pytest.mark.parametrize("most", [1 << 21, 9])
def test_centroids_in_passes(spark, monkeypatch, most):
    """Against NumPy, with all centroids at once and with one or two a pass; null classes without train rows."""
    monkeypatch.setattr(splits, "MODEL_VALUES", most)
    rng = np.random.default_rng(17)
    rows = [(f"p{i}", "train" if i % 3 else "val", f"m{i % 5}", rng.normal(i % 5, 1.5, 4).tolist()) for i in range(90)]
    names = sorted({m for _, _, m, _ in rows})
    centres = np.array([np.mean([v for _, p, m, v in rows if p == "train" and m == c], axis=0) for c in names])
    hit = {part: [names[int(((centres - v) ** 2).sum(axis=1).argmin())] == m for _, p, m, v in rows if p == part] for part in ("train", "val")}
    shape = "path string, part string, machine string, v array<double>"
    got = {r.part: (r.n, r.accuracy) for r in splits.centroid_accuracy(spark.createDataFrame(rows, shape)).collect()}
    assert got.keys() == hit.keys() and all(got[p][0] == len(h) and abs(got[p][1] - np.mean(h)) < 1e-9 for p, h in hit.items())
    alone = splits.centroid_accuracy(spark.createDataFrame([r for r in rows if r[1] == "val"], shape)).collect()
    assert [(r.part, r.n, r.accuracy) for r in alone] == [("val", 30, None)]
