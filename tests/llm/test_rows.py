"""Equality of bytes, and rows that share an id: nothing is taken for equal that is not, and no row is lost."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from brute import near, shingles, words
from conftest import AWKWARD

from rotorlake.llm import decontaminate, near_join, quality as q
from rotorlake.llm.textkernels import span_hashes

SF = "/root/testdata/sf0.001"


def thue_morse(n):
    """A word and its complement, whose polynomial hashes modulo powers of two are equal."""
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_span_hashes_tell_spans_apart():
    rng = random.Random(7)
    spans = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.choice([0, 1, 7, 8, 9, 15, 16, 17, 255, 256, 257, 600]))) for _ in range(3000)]
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    h = span_hashes(data, ends - [len(s) for s in spans], ends)
    assert len({*zip(spans, h.tolist())}) == len(set(spans)) == len(set(h.tolist()))


def test_thue_morse_lines_and_texts(spark, make):
    x, y = thue_morse(2048)
    assert [int(next(q.figures(pa.array([t])))["n_dup_lines"][0]) for t in (f"{x}\n{y}", f"{x}\n{x}\n{y}")] == [0, 1]
    a, b = (" ".join(w) for w in (x, y))
    got = near_join.near_classes(make([(1, x, "en", "s"), (2, y, "en", "s"), (3, a, "en", "s"), (4, b, "en", "s")])).collect()
    assert len({r.class_id for r in got if r.doc_id in (1, 2)}) == 2
    assert sorted(tuple(r) for r in got) == near([(1, x), (2, y), (3, a), (4, b)])


def text(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


def test_one_id_of_several_texts_names_one_class(spark, make):
    a, b = text(1), text(2)
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, a + " x", "en", "s"), (3, b + " x", "en", "s"), (None, a + " y", "en", "s"), (None, text(3), "en", "s")]
    got = near_join.near_classes(make(rows)).collect()
    by = {(r.doc_id, r.n_links): r.class_id for r in got}
    assert by[2, 2] != by[3, 1] and by[2, 2] == 2 and by[3, 1] == 3
    assert sorted((r.doc_id or -1, r.n_links) for r in got) == [(-1, 0), (-1, 2), (1, 1), (1, 2), (2, 2), (3, 1)]


def test_repeated_rows_count_once_per_row(spark, make):
    a = text(4)
    rows = [(6, a, "en", "s"), (6, a, "en", "s"), (7, a + " x", "en", "s"), (8, a + " y", "en", "s")]
    assert sorted(tuple(r) for r in near_join.near_classes(make(rows)).collect()) == near([(d, t) for d, t, _, _ in rows])


@pytest.mark.parametrize("edits", [2, 9])
def test_large_groups_through_pivots(spark, make, monkeypatch, edits):
    """Groups of many blocks: all links of a brute-force join, for documents near and far from the pivot."""
    monkeypatch.setattr(near_join, "BLOCK_DOCS", 24)
    rng, rows = random.Random(edits), []
    base = text(9, 150).split()
    for i in range(220):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(50)}"
        rows.append((i, " ".join(copy), "en", "s"))
    got, want = sorted(tuple(r) for r in near_join.near_classes(make(rows)).collect()), near([(d, t) for d, t, _, _ in rows])
    assert sum(r[2] for r in got) >= 0.999 * sum(r[2] for r in want) and [r[:2] for r in got] == [r[:2] for r in want]
    if edits == 2:
        assert got == want


def test_cover_loses_no_pair():
    """Covering rows with the widened limit find every pair's components that all pairs would find."""
    rng = np.random.default_rng(3)
    n, least = 144, 90
    centre = rng.integers(0, 256, (6, n))
    sig = centre[rng.integers(0, 6, 300)].astype(np.uint8)
    for r in sig:
        k = rng.integers(0, n, rng.integers(0, 50))
        r[k] = rng.integers(0, 256, len(k))
    sig = sig[np.lexsort(sig[:, :3].T[::-1])]
    by, reach = near_join.cover(sig, sig[:, :3], near_join.RADIUS)
    apart = lambda i, j: int((sig[i] != sig[j]).sum())
    assert all(by[by[i]] == by[i] and apart(i, by[i]) <= min(near_join.RADIUS, reach[by[i]]) for i in range(300) if by[i] != i)
    heads = np.flatnonzero(by == np.arange(300))
    left, right = near_join.close_pairs(sig[heads], reach[heads], least)
    root = near_join._stars(300, np.append(heads[left], np.arange(300)), np.append(heads[right], by))
    for i in range(300):
        for j in range(i):
            if n - apart(i, j) >= least:
                assert root[i] == root[j]


def test_recall_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = near([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(tuple(r) for r in near_join.near_classes(docs).collect())
    assert sum(r[2] for r in got) >= 0.999 * sum(r[2] for r in want)
    assert sum(a == b for a, b in zip(got, want)) >= 0.999 * len(want)


# stages of the pipeline

def plain(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def clashing(df):
    """Extra columns with names that stages use themselves."""
    return df.selectExpr("*", "1 as t1", "2 as t2", "3 as copies", "'k' as k_doc_id", "4 as rows", "5 as item_id", "6 as node", "7 as class_key")


def test_no_distinct_text_is_lost(spark, make):
    a, b = text(11), text(12)
    rows = [(5, a, "en", "s"), (5, b, "en", "s"), (6, b, "en", "s")]
    assert plain(corpus_pipeline.near_duplicates(spark, make(rows), SF)) == sorted([(5, a), (5, b)], key=repr)


def test_near_stage_of_awkward_rows(spark, make, awkward, empty):
    kept = plain(corpus_pipeline.near_duplicates(spark, clashing(awkward), SF))
    want = [(d, t) for d, t, _, _ in AWKWARD]
    want.remove((6, "one two three"))
    want.remove((6, "one two three"))
    assert kept == sorted(want, key=repr)
    rows = [(None, text(13), "en", "s"), (None, text(13) + " x", "en", "s"), (9, text(13) + " y", "en", "s"), (None, text(14), "en", "s"), (None, text(14), "en", "s")]
    assert plain(corpus_pipeline.near_duplicates(spark, make(rows), SF)) == sorted([(9, text(13) + " y"), (None, text(14))], key=repr)
    assert corpus_pipeline.near_duplicates(spark, empty, SF).count() == 0


def test_decontamination_stage_drops_rows_not_ids(spark, make, awkward, empty, tmp_path):
    item = text(20, 40)
    spark.createDataFrame([(None, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(5, item + " tail", "en", "s"), (5, text(21), "en", "s"), (None, "head " + item, "en", "s"), (None, text(22), "en", "s"), (7, None, "en", "s"), (7, "", None, None), (8, text(21), "en", "s"), (8, text(21), "en", "s")]
    got = plain(corpus_pipeline.decontamination(spark, clashing(make(rows)), str(tmp_path)))
    assert got == sorted([(d, t) for d, t, _, _ in rows if item not in (t or "")], key=repr)
    assert plain(corpus_pipeline.decontamination(spark, awkward, str(tmp_path))) == sorted([(d, t) for d, t, _, _ in AWKWARD], key=repr)
    assert corpus_pipeline.decontamination(spark, empty, str(tmp_path)).count() == 0
    ties = decontaminate.contaminated(make([(1, f"{item} zz {item}", "en", "s")]), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()
    assert [(r.doc_id, r.item_id, r.matched, r.doc_word) for r in ties] == [(1, None, 40, 0)]


def test_quality_stage_of_awkward_rows(spark, awkward, empty, tmp_path):
    spark.createDataFrame([(10, 1), (None, 1), (8, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = plain(corpus_pipeline.quality_rules(spark, clashing(awkward), str(tmp_path)))
    want = []
    for d, t, _, _ in AWKWARD:
        w = words(t)
        seen = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        inside = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
        if len(w) >= 10 and 100 * len(inside) <= 20 * len(w):
            want.append((d, t))
    assert got == sorted(want, key=repr)
    assert corpus_pipeline.quality_rules(spark, empty, str(tmp_path)).count() == 0


def test_mix_and_token_stages_of_awkward_rows(spark, make, awkward, empty):
    got = plain(corpus_pipeline.source_mix(spark, clashing(awkward), SF))
    known = {(d, t) for d, t, _, _ in AWKWARD}
    assert set(got) <= known and all(words(t) for _, t in got)
    rows = [(5, text(30), "en", "a"), (5, text(31), "en", "a"), (5, text(31), "en", "a"), (None, text(32), "en", "b"), (None, text(33), "en", None)]
    mixed = plain(corpus_pipeline.source_mix(spark, make(rows), SF))
    assert set(mixed) <= {(d, t) for d, t, _, _ in rows} and all(mixed.count(r) <= 3 * rows.count((*r, "en", "a")) for r in mixed if r[0] == 5)
    assert abs(len(mixed) - len(rows)) <= 1
    assert corpus_pipeline.source_mix(spark, empty, SF).count() == 0
    files = corpus_pipeline.token_output(spark, clashing(awkward), SF).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in files) == sorted((d is not None, d or 0) for d, *_ in AWKWARD)
    assert corpus_pipeline.token_output(spark, empty, SF).count() == 0


def test_shingles_are_five_words():
    assert len(shingles(text(1))) == 76
