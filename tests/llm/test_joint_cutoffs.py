"""Joint cutoffs of the quality rules: fewer labels suffice, and the promise holds for the rules together."""

import numpy as np

import corpus_pipeline
from rotorlake.llm import quality as q


def documents(n_good, n_bad, lang, first):
    prose = [f"word{i}" for i in range(60)]
    rows = [(first + i, " ".join(prose), lang, "s") for i in range(n_good)]
    return rows + [(first + n_good + i, " ".join([*prose, *["#$%&"] * 15]), lang, "s") for i in range(n_bad)]


def test_junk_is_rejected_with_few_labels(spark, make):
    rows = documents(320, 40, "es", 0) + documents(150, 10, "fr", 1000)
    labels = spark.createDataFrame([(r[0], int("#" not in r[1])) for r in rows], "doc_id long, quality int")
    measured = q.measure(make(rows))
    out = q.judge(measured, q.joint_thresholds(measured, q.good_documents(labels))).collect()
    assert {r.doc_id for r in out if not r.kept} == {r[0] for r in rows if r[2] == "es" and "#" in r[1]}
    split = q.judge(measured, q.thresholds(measured, q.good_documents(labels)))
    assert split.where("not kept").count() == 0


def test_counts_are_of_the_union(spark, make):
    """Rules that reject different documents use up the limit together."""
    rows = documents(300, 0, "en", 0)
    rows += [(500, rows[0][1] + " #####" * 12, "en", "s"), (501, rows[0][1] + " !!!!!" * 12, "en", "s")]
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    measured = q.measure(make(rows))
    cut = q.joint_thresholds(measured, q.good_documents(labels)).head()
    # about 83 marks per 100 words: of 302 one rejected document is within the limit, two are not
    assert (cut.n_good, cut.symbols_per_100_words, cut.bangs_per_100_words) == (302, 75, 100)


def test_pipeline_drops_the_junk(spark, make, tmp_path):
    rows = documents(320, 40, "es", 0)
    spark.createDataFrame([(r[0], int("#" not in r[1])) for r in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality_rules(spark, make(rows), str(tmp_path)).count() == 320


def test_promise_of_the_walk():
    rng = np.random.default_rng(6)
    walk, broken = q.joint_walk(), 0
    assert {r: tuple(c for x, c in walk if x == r) for r in q.RULES} == q.RULES
    for _ in range(200):
        x = {r: rng.exponential(3, 500) for r in q.RULES}
        hit, counts, cut = np.zeros(500, bool), [], {}
        for r, c in walk:
            hit |= x[r] > c
            counts.append(int(hit.sum()))
        cut = dict(walk[: q.certified(500, counts, 0.02, 0.05)])
        broken += 1 - np.prod([1 - np.exp(-c / 3) for c in cut.values()]) > 0.02
    assert broken <= 20
