"""The overlap of operator 7 against every stretch of a diagonal."""

import numpy as np

from rotorlake.llm import decontaminate


def every_stretch(doc, item, diagonal, share):
    """(matched, length, -start) of the stretch with most matches among all that begin and end at a match."""
    best = (0, 0, 0)
    at = [p for p in range(len(item)) if 0 <= p + diagonal < len(doc) and doc[p + diagonal] == item[p]]
    for i, p in enumerate(at):
        for k, z in enumerate(at[i:]):
            if k + 1 >= share * (z - p + 1) - 1e-9:
                best = max(best, (k + 1, z - p + 1, -p))
    return best


def test_overlap_against_every_stretch():
    rng = np.random.default_rng(8)
    for k in range(600):
        item = rng.integers(0, 1 << 60, rng.integers(1, 70)).astype(np.uint64)
        doc = np.where(rng.random(len(item)) < rng.choice([0.1, 0.2, 0.3, 0.5]), np.uint64(1 << 61), item)
        d = int(rng.integers(-3, 6))
        doc = np.append(np.zeros(max(0, d), np.uint64), doc[max(0, -d) :])
        share = (0.8, 0.5, 0.9, 1.0)[k % 4]
        m, size, start = decontaminate.overlap(doc, item, d, share)
        assert (m, size, -start) == every_stretch(doc, item, d, share)


def test_two_changed_runs_of_words(spark, make):
    item = [f"w{i}" for i in range(51)]
    copy = [f"x{i}" if 13 <= i < 19 or 32 <= i < 38 else w for i, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontaminate.contaminated(make([(7, "before " + " ".join(copy) + " after", "en", "s")]), bench).collect()
    assert [(r.doc_id, r.item_id, r.matched, r.overlap_words, r.item_word, r.doc_word) for r in got] == [(7, 1, 26, 32, 0, 1)]
