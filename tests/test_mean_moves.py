"""The mean scorer takes the means to the rows, so an id's rows are no single task and are scored where they are."""

from rotorlake.operators import scoring


def test_rows_stay_where_they_are(spark, capsys, tmp_path):
    rows = [("m", "a", "test_abnormal" if i % 2 else "train", i, [1.0 + i % 3, float(i % 5)]) for i in range(60)] + [("m", "b", "train", 60, [0.0, 0.0]), ("m", "b", "test_normal", 61, [1.0, 0.0])]
    # from files, whose size Spark does not take for that of the means
    spark.createDataFrame(rows, "machine string, machine_id string, split string, vec_id long, v array<double>").write.parquet(f"{tmp_path}/rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1500")
    try:
        made = scoring.mean_scores(spark.read.parquet(f"{tmp_path}/rows"))
        got = {r.vec_id: r.score for r in made.collect()}
        made.explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    train = [r[4] for r in rows if r[2] == "train" and r[1] == "a"]
    mx, my = sum(v[0] for v in train) / len(train), sum(v[1] for v in train) / len(train)
    for _, machine_id, split, i, v in rows:
        if split != "train":
            want = 1 - (v[0] * mx + v[1] * my) / ((v[0] ** 2 + v[1] ** 2) ** 0.5 * (mx**2 + my**2) ** 0.5) if machine_id == "a" else 1.0
            assert abs(got[i] - want) < 1e-12
    assert len(got) == 31
