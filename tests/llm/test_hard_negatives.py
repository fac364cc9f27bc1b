"""Hard negatives against scoring every pair."""

import math
import random

import numpy as np
import pytest
from compare import same, tables

from rotorlake.llm import hard_negatives as hn

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, rid string, y double, cell string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", 0.5, "c", "s") for r in rows], SCHEMA).repartition(3)


def brute(rows, anchors=100):
    """Rows of (vec_id, vector, label) that take part."""
    ys = [[max(-(1 << 26), min(1 << 26, math.floor(256 * c))) for c in v] for _, v, _ in rows]
    out = []
    for i, (a, _, label) in enumerate(rows):
        if a % anchors:
            continue
        scored = sorted((-sum(p * q for p, q in zip(ys[i], ys[j], strict=True)), rows[j][0], rows[j][2]) for j in range(len(rows)) if j != i)
        for ps, p, _ in [x for x in scored if x[2] == label][:5]:
            window = [x for x in scored if x[2] != label and 80 * -ps <= 100 * -x[0] <= 100 * -ps]
            out += [(a, p, k, x[1], -ps, -x[0]) for k, x in enumerate(window[:5], 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in hn.mine(hn.whole_rows(df), **kw).collect())


def test_query_equals_sql(spark):
    same(hn.op13_hard_negatives(spark, SF), tables(SF), hn.OP13_SQL)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(1)
    good = [(i, [rng.uniform(-1, 2) for _ in range(5)], i % 3) for i in range(0, 120)]
    good += [(0, [1.0, 1.0, 1.0, 0.5, 0.0], 0), (0, [1.0, 1.0, 1.0, 0.5, 0.0], 0), (100, [0.0] * 5, 1), (300, [1e30, 0.0, 0.0, 0.0, -1e300], 1), (301, [1e30, 0.0, 0.0, 0.0, -1e300], 1), (302, [1e29, 0.0, 0.0, 0.0, -1.0], 0)]
    good += [(400, [1.0] * 5, 7), (-100, [0.5] * 5, -1), (-101, [0.5] * 5, -1)]
    bad = [(None, [1.0] * 5, 1), (500, None, 1), (600, [1.0] * 5, None), (700, [], 1), (800, [1.0, None, 1.0, 1.0, 1.0], 1), (900, [nan] * 5, 1), (1000, [inf] * 5, 1), (1100, [1.0], 1)]
    assert got(frame(spark, good + bad)) == brute(good)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 1)], [(100, [1.0], 1), (200, [1.0], 1)], [(5, [1.0, 2.0], 1), (6, [1.0, 2.0], 2)]])
def test_small_tables(spark, rows):
    assert got(frame(spark, rows)) == brute(rows)


def test_copies_ties_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "SEED_ROWS", 20)
    rng = np.random.default_rng(3)
    spots = rng.normal(size=(6, 8))
    rows = [(i, (spots[i % 6] + (0.05 * rng.normal(size=8) if i % 5 else 0)).round(2).tolist(), int(rng.integers(0, 4))) for i in range(600)]
    rows += [(i, [1.0, 0.5] * 4, i % 2) for i in range(600, 900)]  # a third are copies
    assert got(frame(spark, rows), anchors=30, words=5) == brute(rows, 30)


def test_walk_is_in_order_and_stops_where_certified():
    rng = np.random.default_rng(4)
    spots = rng.normal(size=(40, 16)) * 100
    y = np.floor(spots[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16))).astype(np.int64)
    codes = hn.Codes(hn.k_means(y[:, :8], 16), hn.k_means(y[:, 8:], 16))
    cell, ra, rb = codes.cells(y)
    for c in range(codes.rows.size):
        m = cell == c
        codes.rows.flat[c] = m.sum()
        codes.radius[0].flat[c], codes.radius[1].flat[c] = ra[m].max(initial=0), rb[m].max(initial=0)
    visited = []
    for k in range(0, 3000, 100):
        s = y @ y[k]
        floor = int(np.sort(s)[-6])
        cells = list(codes.walk(y[k], floor, None))
        assert set(cell[s >= floor]) <= set(cells) and len(set(cells)) == len(cells)
        visited.append(sum(codes.rows.flat[c] for c in cells))
        assert list(codes.walk(y[k], hn.LOWEST, 50)) == list(codes.walk(y[k], hn.LOWEST, None))[: len(list(codes.walk(y[k], hn.LOWEST, 50)))]
        assert set(codes.walk(y[k], hn.LOWEST, None)) == set(np.flatnonzero(codes.rows.ravel()))
    assert np.mean(visited) < 0.5 * 3000


def test_blocks_hold_every_row_once(spark, monkeypatch):
    rows = hn.whole_rows(spark.read.parquet(f"{SF}/embeddings.parquet"))
    index = hn.MultiIndex(rows, 3)
    held = [(r.cell, np.frombuffer(r.rids, np.int64)) for r in spark.table(index.name).collect()]
    assert sorted(np.concatenate([x for _, x in held])) == sorted(r.rid for r in rows.select("rid").collect())
    assert all((np.diff(np.frombuffer(r.ids, np.int64)) >= 0).all() for r in spark.table(index.name).collect())
    index.drop()


def test_products_are_exact():
    a = np.array([[1 << 26, -(1 << 26), 3]])
    assert hn.products(a, a).tolist() == [[(1 << 53) + 9]]
