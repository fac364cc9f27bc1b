"""Guards raise with counts from the one write; refreshed features are computed once."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_signals import wav

from rotorlake.operators import cache, degraded, guards, splits


def test_faults_are_counted_and_set_aside(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else float(i)) for i in range(20)], "k long, x double")
    with pytest.raises(guards.GuardError) as e:
        guards.checked(rows, path, {"no_x": F.col("x").isNull(), "large": F.col("x") > 17}, some={"small": F.col("x") < 0})
    assert e.value.counts == {"no_x": 4, "large": 2, "small": 0}
    good = guards.checked(rows, path, {"no_x": F.col("x").isNull(), "large": F.col("x") > 17}, allowed=["no_x", "large"])
    assert sorted(r.k for r in good.collect()) == [i for i in range(18) if i % 5] and good.columns == ["k", "x"]
    assert sorted((r.k, r.fault) for r in guards.set_aside(spark, path).collect()) == [(0, "no_x"), (5, "no_x"), (10, "no_x"), (15, "no_x"), (18, "large"), (19, "large")]
    assert guards.checked(rows.where("false"), str(tmp_path / "none"), {"no_x": F.col("x").isNull()}).count() == 0


def test_the_source_is_scanned_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(500).mapInArrow(count, "id long")
    guards.checked(rows, str(tmp_path / "r"), {"odd": F.col("id") % 2 == 1}, some={"even": F.col("id") % 2 == 0}, allowed=["odd"]).count()
    assert seen.value == 500


def test_missing_features(spark, tmp_path):
    clips = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "path string, n int")
    features = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", [1.0, float("nan")])], "path string, v array<double>")
    with pytest.raises(guards.GuardError) as e:
        guards.with_features(clips, features, 2, str(tmp_path / "f"))
    assert e.value.counts == {"no_feature": 1, "width": 1, "not_finite": 1}
    assert [r.path for r in guards.with_features(clips, features, 2, str(tmp_path / "f"), allowed=["no_feature", "width", "not_finite"]).collect()] == ["a"]


def test_sides_splits_and_bands(spark, tmp_path):
    clips = spark.createDataFrame([("m", f"id_0{i}", "abnormal" if k < i + 1 else "normal", f"{k}.wav") for i in range(3) for k in range(4)], "machine string, machine_id string, label string, path string")
    with pytest.raises(guards.GuardError, match="val: 0"):
        guards.sides(splits.id_disjoint(clips, ["id_09"]), str(tmp_path / "s"))
    assert guards.sides(splits.id_disjoint(clips, ["id_01"]), str(tmp_path / "s")).count() == 12
    with pytest.raises(guards.GuardError) as e:
        guards.split_with_train(splits.anomaly_split(clips), str(tmp_path / "t"))
    assert e.value.counts == {"few_normals": 8}
    assert guards.split_with_train(splits.anomaly_split(clips.where("machine_id = 'id_00'")), str(tmp_path / "t")).count() == 4
    bins = spark.createDataFrame([(v, float(f), 1.0) for v in (1, 2) for f in range(100, 1000, 10) if v == 1 or f < 400], "vec_id long, freq double, gain_db double")
    gains = degraded.band_gains(bins, 4, 100.0, 1000.0)
    with pytest.raises(guards.GuardError, match="empty_band"):
        guards.whole_bands(gains, 4, str(tmp_path / "b"))
    assert {r.vec_id for r in guards.whole_bands(gains, 4, str(tmp_path / "b"), allowed=["empty_band"]).collect()} == {1}


def test_only_new_and_changed_files_are_computed(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    opened = spark.sparkContext.accumulator(0)

    def sizes(rows):
        def run(batches):
            for b in batches:
                opened.add(len(b))
                yield b.assign(n=[len(c) for c in b["content"]])[["path", "n"]]

        return rows.mapInPandas(run, "path string, n long")

    def put(name, n, at):
        (root / name).write_bytes(wav(np.zeros(n)))
        os.utime(root / name, (at, at))

    def go():
        before = opened.value
        got = cache.refresh(spark, str(root), store, "size", sizes, "n long", parts=8)
        rows = cache.load(spark, store, "size").collect()
        assert [(r.path.rsplit("/", 1)[1], r.n) for r in rows] == sorted((p.name, p.stat().st_size) for p in root.iterdir())
        return (*got.values(), opened.value - before)

    for i in range(12):
        put(f"{i:02d}.wav", 100 + i, 1_700_000_000 + i)
    assert go() == (12, 0, 0, 12)
    files = {p: os.stat(p).st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert go() == (0, 12, 0, 0)
    put("03.wav", 999, 1_700_000_500)
    assert go() == (1, 11, 0, 1)
    later = {p: os.stat(p).st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert len({p.parent for p in files if later.get(p) != files[p]}) == 1
    put("99.wav", 5, 1_700_000_900)
    (root / "05.wav").unlink()
    assert go() == (1, 11, 1, 1)
    for p in list(root.iterdir()):
        p.unlink()
    put("only.wav", 7, 1_700_001_000)
    assert go() == (1, 0, 12, 1)
