"""What neighbour searches move and hold: few copies of vectors, one pair of blocks at a time."""

from pathlib import Path

import numpy as np

from rotorlake.operators import evidence, neighbours, scoring

SHAPE = "machine string, machine_id string, split string, vec_id long, v array<double>"


def clips(spark, n, size):
    rng = np.random.default_rng(8)
    return spark.createDataFrame([("m", "a", "test_abnormal" if i % 4 == 0 else "train", i, rng.normal(size=size).tolist()) for i in range(n)], SHAPE)


def test_a_task_holds_one_pair_of_bounded_blocks(spark, monkeypatch, capsys):
    monkeypatch.setattr(neighbours, "VALUES", 4000)
    df = clips(spark, 400, 50)
    train = df.where("split = 'train'").selectExpr("*", "cast(vec_id as double) as t")
    near = evidence.nearest_baseline(df.where("split <> 'train'"), train, ["machine", "machine_id"])
    near.explain()
    plan = capsys.readouterr().out
    # batches of a map hold thousands of rows, however wide
    assert "MapInPandas" not in plan and "CoGroups" in plan
    u = {r.vec_id: neighbours.units(np.array([r.v]))[0] for r in df.collect()}
    for r in near.collect():
        assert r.times == sorted((float(t) for t in u if t % 4), key=lambda t: (round(1 - float(u[r.vec_id] @ u[int(t)]), 12), t))[:3]
    sizes = [len(r.u) for r in neighbours.Neighbours(train, ["machine", "machine_id"], "t").packed.collect()]
    # hash blocks vary around 80 rows of 50 numbers
    assert len(sizes) == 4 and max(sizes) < 1.5 * 8 * 4000


def test_vectors_are_not_written_for_each_cell(spark):
    def tables():
        return {p.name.split("-")[1] for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("rotorlake-*") if p not in before}

    before = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("rotorlake-*"))
    assert scoring.knn_scores(clips(spark, 400, 16)).count() == 100
    # each side once as it is, the train rows once more packed; no table of visits
    assert tables() == {"train", "blocks", "queries"}
