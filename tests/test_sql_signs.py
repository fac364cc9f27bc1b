"""Rounded vectors against their SQL to the last bit: zeros keep their sign, halves go away from zero."""

import duckdb
import pytest

from rotorlake.plans import queries_eval


@pytest.mark.parametrize("name", ["mono_mix", "mean_vector"])
def test_zeros_keep_their_sign(spark, tmp_path, name):
    small = [-1e-7, -2e-7, 1e-7, 1e-7, 2e-7, 0.5, -0.0, -0.0, -0.0, 0.0, -0.0, 0.0, 1.5e-6, 1.5e-6, 1.5e-6, -1.5e-6, -1.5e-6, -1.5e-6, 0.25, 0.5]
    rows = [(i, 1 + i % 2, [x * (1 if i < 3 else 3) for x in small]) for i in range(6)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries_eval.Q[name](spark, str(tmp_path))
    r = con.execute(queries_eval.O[name])
    assert got.columns == [x[0] for x in r.description]
    want = sorted(map(repr, r.fetchall()))
    assert any("-0.0," in w for w in want) and sorted(repr(tuple(x)) for x in got.collect()) == want
