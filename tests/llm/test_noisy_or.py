"""The noisy-or fit: its gradient by differences, and what it finds from weights of zero."""

import numpy as np
import pyarrow as pa
import pytest

from rotorlake.llm import toxicity as t
from rotorlake.llm.textkernels import texts


def bags(rows):
    parts, n = [], 0
    for c in texts(pa.array([x for x, _ in rows])):
        slots, sentence, first, _ = t.features(c)
        parts.append((slots, sentence + n, first[:-1] + n))
        n += int(first[-1])
    slots, sentence, first = (np.concatenate(x) for x in zip(*parts))
    return slots, sentence, np.append(first, n), np.array([y for _, y in rows])


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        sentences = [" ".join(f"w{k}" for k in rng.integers(0, 60, 6)) for _ in range(rng.integers(2, 6))]
        if i % 4 == 0:
            sentences[rng.integers(0, len(sentences))] += f" vile{rng.integers(0, 3)}"
        rows.append((". ".join(sentences), int(i % 4 == 0)))
    return rows


def by_hand(rows, x, b):
    """Loss of the noisy-or, sentence by sentence in plain Python."""
    n_toxic, value = sum(y for _, y in rows), t.L2 / 2 * (x[:-1] ** 2).sum()
    number = {int(s): k for k, s in enumerate(b.used)}
    slots, sentence, first, _ = bags(rows)
    for d, (_, y) in enumerate(rows):
        none = 1.0
        for s in range(first[d], first[d + 1]):
            z = x[-1] + sum(x[number[int(f)]] for f in slots[sentence == s].reshape(-1) if int(f) in number)
            none *= 1 - 1 / (1 + np.exp(-z))
        weight = t.TOXIC_SHARE / n_toxic if y else (1 - t.TOXIC_SHARE) / (len(rows) - n_toxic)
        value -= weight * np.log(1 - none if y else none)
    return value


def test_loss_and_gradient():
    rows = corpus(24)
    b = t.Bags(*bags(rows))
    rng = np.random.default_rng(2)
    x = np.append(rng.normal(0, 0.3, len(b.used)), -1.5)
    value, g = b.loss(x)
    assert value == pytest.approx(by_hand(rows, x, b))
    for k in [*rng.integers(0, len(x), 12).tolist(), len(x) - 1]:
        e = np.zeros(len(x))
        e[k] = 1e-6
        assert g[k] == pytest.approx((b.loss(x + e)[0] - b.loss(x - e)[0]) / 2e-6, rel=1e-4, abs=1e-8)


def test_fit_starts_at_zero_and_finds_the_sentence(spark, make):
    rows = corpus(400)
    b = t.Bags(*bags(rows))
    assert not b.start()[:-1].any()
    table = make([(i, x, "en", "s") for i, (x, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    w, bias = t.train(table, labels)
    got = {r.doc_id: r for r in t.score(table, w, bias).collect()}
    right = sum((got[i].score >= 0.5) == (y == 1) for i, (_, y) in enumerate(rows))
    place = sum("vile" in x.split(".")[got[i].worst_sentence] for i, (x, y) in enumerate(rows) if y)
    assert right >= 0.95 * len(rows) and place >= 0.95 * sum(y for _, y in rows)


def test_repeated_ids_are_learnt_once(spark, make):
    rows = [(1, f"word{i} here", "en", "s") for i in range(50)] + [(2, "other", "en", "s")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert sorted((r.doc_id, r.text) for r in t.training_sample(make(rows), labels).collect()) == [(1, "word0 here"), (2, "other")]
