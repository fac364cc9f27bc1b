"""The forest's walk, and the maps that spare texts the shuffle, against plain NumPy."""

import random

import numpy as np
import pytest

from rotorlake.llm import near_join as nj
from rotorlake.llm.common import text_keys
from rotorlake.llm.decontaminate import bitmap_of


def test_documents_stop_at_depths_of_their_own(spark):
    """On the small table: several depths, fewer candidates than all pairs that share the shortest prefix."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    reps = nj.representatives(docs)[-1]
    walked = nj.walk_tries(reps, nj.TREES, nj.THRESHOLD).where("b is not null").toPandas()
    stops = walked["stop"].value_counts()
    print("stops", dict(sorted(stops.items())))
    assert set(stops.index) <= set(range(nj.depth_for(), nj.MAX_DEPTH + 1)) and len(stops) > 1 and stops.get(nj.MAX_DEPTH, 0)
    rows = reps.select("node", "paths").collect()
    by = {}
    for r in rows:
        for t, p in enumerate(r.paths):
            by.setdefault((t, p), []).append(r.node)
    banded = {(min(a, b), max(a, b)) for m in by.values() for i, a in enumerate(m) for b in m[:i]}
    met = {(min(a, b), max(a, b)) for a, b in zip(walked["a"], walked["b"])}
    print("candidates", len(met), "of", len(banded))
    assert met <= banded and len(met) < len(banded)


def test_stop_is_a_common_prefix():
    rng = np.random.default_rng(11)
    sig = np.repeat(rng.integers(0, 256, (1, 144)), 60, axis=0).astype(np.uint8)
    for r in sig:
        k = rng.integers(0, 144, rng.integers(0, 9))
        r[k] = rng.integers(0, 256, len(k))
    tails = sig[:, :3]
    sig = sig[np.lexsort(tails.T[::-1])]
    tails, stop = sig[:, :3], np.zeros(60, np.int64)
    by, _ = nj.cover(sig, tails, nj.RADIUS, stop)
    gone = np.flatnonzero(by != np.arange(60))
    assert len(gone) and len(set(stop[gone])) > 1 and not stop[by == np.arange(60)].any()
    assert all((tails[i, : stop[i]] == tails[by[i], : stop[i]]).all() for i in gone)


@pytest.mark.parametrize("bits", [1 << 10, 1 << 21])
def test_map_of_hashes(spark, bits):
    rng = random.Random(bits)
    hashes = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] * 2 + [0, -1, -(1 << 63), (1 << 63) - 1]
    got = bitmap_of(spark.createDataFrame([(h,) for h in hashes], "hash long").repartition(5), bits)
    want = np.zeros(bits, np.uint8)
    want[[h % bits for h in hashes]] = 1
    assert len(got) == bits // 8 and (np.unpackbits(got, bitorder="little") == want).all()
    none = bitmap_of(spark.createDataFrame([], "hash long"), bits)
    assert len(none) == bits // 8 and not none.any()


@pytest.mark.parametrize("most", [nj.MOST_BITS, 2])
def test_rows_leave_with_and_without_a_map(spark, make, monkeypatch, most):
    monkeypatch.setattr(nj, "MOST_BITS", most)
    rows = [(i if i % 9 else None, f"text {i % 50}", "en", "s") for i in range(200)]
    docs = make(rows).select("doc_id", "text", *text_keys())
    leave = docs.where("doc_id % 3 = 1 or doc_id is null and text = 'text 0'").selectExpr("doc_id k_doc_id", "t1 k_t1", "t2 k_t2").distinct()
    got = sorted((r.doc_id or -1, r.text) for r in nj.without_rows(docs, leave).collect())
    assert got == sorted((d or -1, t) for d, t, _, _ in rows if not (d and d % 3 == 1 or d is None and t == "text 0"))
    assert bool(nj.map_bits(leave.count())) == (most > 2)


def test_links_are_the_same_without_a_map(spark, make, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    rows = [(i, " ".join([*base[: i * 3], f"x{i}", *base[i * 3 :]]) if i < 20 else f"other {i} " * 9, "en", "s") for i in range(40)]
    with_map = sorted(map(tuple, nj.near_classes(make(rows)).collect()))
    monkeypatch.setattr(nj, "MOST_BITS", 2)
    assert with_map == sorted(map(tuple, nj.near_classes(make(rows)).collect())) and with_map[0][2] >= 19


def test_map_sizes():
    assert nj.map_bits(0) == nj.map_bits(1000) == nj.LEAST_BITS and nj.map_bits(10**6) == 1 << 25
    assert nj.map_bits(nj.MOST_BITS // 2) == nj.MOST_BITS and nj.map_bits(nj.MOST_BITS) == 0
