"""Copies of documents and of benchmark items are compared once, and every row gets its result."""

import random

from pyspark.sql import functions as F

from rotorlake.llm import decontaminate

W = [f"w{k}" for k in range(500)]


def words(r, n):
    return " ".join(r.choices(W, k=n))


def test_copies_of_documents_and_items_all_get_their_rows(spark):
    r = random.Random(5)
    items = [words(r, 30) for _ in range(4)]
    texts = [f"{words(r, 40)} {items[k]} {words(r, 40)}" for k in range(3)] + [words(r, 60)]
    # one text with two items far apart, one with the same item twice
    texts += [f"{items[0]} {words(r, 300)} {items[3]}", f"{words(r, 5)} {items[1]} {words(r, 200)} {items[1]}"]
    copies = [60, 1, 7, 30, 9, 11]
    docs = [(100 * k + n, t) for k, (t, m) in enumerate(zip(texts, copies)) for n in range(m)]
    # the same passages at other places of the document
    docs += [(9000 + n, f"{words(r, n)} {texts[0]}") for n in range(1, 6)]
    bench = [(k, t) for k, t in enumerate(items)] + [(50 + n, items[0]) for n in range(5)] + [(50, items[0])]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(bench, "item_id long, text string")).collect()

    names = {t: sorted({i for i, x in bench if x == t}) for t in items}
    want = set()
    for doc_id, t in docs:
        for item in items:
            at = t.find(item)
            if at >= 0:
                want |= {(doc_id, i, 30, 30, 0, len(t[:at].split())) for i in names[item]}
    # the overlap may run on where a neighbouring word also matches by chance: never here, items are whole
    assert {tuple(x) for x in got} == want
    assert len(got) == len(want)


def test_equal_stretches_are_compared_once(spark, monkeypatch):
    r = random.Random(6)
    item = words(r, 30)
    text = f"{words(r, 50)} {item} {words(r, 50)}"
    seen = {}
    real = decontaminate.materialise

    def counted(df, name):
        out = real(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(decontaminate, "materialise", counted)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    bench = spark.range(6).select(F.col("id").alias("item_id"), F.lit(item).alias("text"))
    assert decontaminate.contaminated(docs, bench).count() == 2400
    assert (seen["stretches"], seen["single-stretches"], seen["items"], seen["diagonals"]) == (400, 1, 1, 1)
