"""The secret scan's forest against labels that no pattern decides, and its candidates against plain Python."""

import random

import numpy as np
import pytest
from conftest import AWKWARD

from rotorlake.llm import secret_findings as made_up, secrets_scan as s

RUN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
NAMES = ["password", "passwd", "pass", "pwd", "token", "secret", "apikey", "api_key", "api-key", "credential"]


def stretches(text, letters):
    out, at = [], 0
    while at < len(text):
        if text[at] not in letters:
            at += 1
            continue
        z = at
        while z < len(text) and text[z] in letters:
            z += 1
        out.append((at, z))
        at = z
    return out


def by_hand(text):
    """Runs, dotted runs and plain assigned values of an ASCII text, letter by letter."""
    out = {(a, z) for a, z in stretches(text, RUN) if z - a >= 16}
    for a, z in stretches(text, RUN | {"."}):
        # pieces between dots: as many as stand side by side
        parts, at = [], a
        for p in text[a:z].split("."):
            parts.append((at, at + len(p)))
            at += len(p) + 1
        group = []
        for p in [*parts, (0, 0)]:
            if p[1] > p[0]:
                group.append(p)
                continue
            if len(group) > 1 and group[-1][1] - group[0][0] >= 16:
                out.add((group[0][0], group[-1][1]))
            group = []
    for name in NAMES:
        for a in (i for i in range(len(text)) if text[i : i + len(name)].lower() == name):
            z = a + len(name)
            while z < len(text) and text[z] in " \n":
                z += 1
            if text[z : z + 1] not in ("=", ":"):
                continue
            z += 1
            while z < len(text) and text[z] in " \n":
                z += 1
            e = z
            while e < len(text) and text[e] not in " \n":
                e += 1
            if e > z:
                out.add((z, z + (len(text[z:e].rstrip(".,;)]}>")) or e - z)))
    return out


def test_candidates_against_plain_python(spark, make):
    rng, rows = random.Random(5), []
    pieces = ["abc", "k" * 15, "k" * 16, "a.b", ".", "..", "/", "password=", "Token: ", "api_key =", "secret:", " ", "\n", "x9", "0123456789abcdef", "!", "#?", "end.", ","]
    for i in range(400):
        rows.append((i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))), "en", "s"))
    got = {(r.doc_id, r.start, r.start + r.length) for r in s.candidates(make(rows), np.zeros(s.BINS, np.int64)).collect()}
    assert got == {(i, a, z) for i, t, _, _ in rows for a, z in by_hand(t)}


def test_labels_are_where_they_say():
    n = 0
    for k in range(500):
        text, path, start, length, label = made_up.finding(k)
        value = text.encode()[start : start + length].decode()
        assert value and value in text and path and label in (0, 1)
        n += label
    assert 200 < n < 300 and made_up.finding(7) == made_up.finding(7) != made_up.finding(7, seed=2)


@pytest.fixture(scope="module")
def held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labelled, made = s.training_findings(spark, s.dictionary(docs))
    model = s.fit(labelled.where("not held_out"))
    rows = s.judged(labelled.where("held_out"), model).select("doc_id", "label", "rule", "probability").toPandas()
    return rows, made.where("held_out").toPandas()


def rates(reported, secrets, n_secrets):
    return (reported & secrets).sum() / max(1, reported.sum()), (reported & secrets).sum() / n_secrets


def test_forest_removes_what_the_rule_reports_in_vain(held_out):
    rows, made = held_out
    secret, n = rows["label"] == 1, int((made["label"] == 1).sum())
    rule, forest = rows["rule"] == 1, rows["probability"] >= 0.5
    p_rule, r_rule = rates(rule, secret, n)
    p_both, r_both = rates(rule & forest, secret, n)
    p_forest, r_forest = rates(forest, secret, n)
    print(f"held out {len(made)}, secrets {n}, candidates {len(rows)}; precision and recall: rule {p_rule:.3f} {r_rule:.3f}, rule and forest {p_both:.3f} {r_both:.3f}, forest {p_forest:.3f} {r_forest:.3f}")
    assert r_forest >= 0.9 and p_forest >= 0.9 and p_forest > p_rule + 0.05
    false = rule & ~secret
    assert false.sum() > 20 and (false & ~forest).sum() >= 0.7 * false.sum()
    assert (~rule & secret & forest).sum() > 20


def test_planted_look_alikes(spark, make):
    hexed = "908038b7daaf91e730d2f64001c52934d43d9336"
    texts = [(f'words token = "{hexed}" and words', hexed, True), (f"words commit {hexed} and words", hexed, False), ('words password = "changeme123" and', "changeme123", False), ('token = "example_value_0001" and', "example_value_0001", False), ('words password = "hunter2xyz9" and words', "hunter2xyz9", True)]
    rows = [(i, t, "en", "web") for i, (t, _, _) in enumerate(texts)]
    got = {(r.doc_id, r.start): r for r in s.scan(make(rows)).collect()}
    verdict = [got[i, t.index(v)].is_secret for i, (t, v, _) in enumerate(texts)]
    assert verdict == [w for _, _, w in texts]


def test_awkward_rows(spark, make, awkward):
    long = "word " * 200_000 + "password=Zx81k2m9q7!"
    rows = [(1, None, "en", "s"), (2, "", None, None), (None, "token = a7f3k9d2m5q8x1z4", None, None), (3, "token = a7f3k9d2m5q8x1z4", "en", "s"), (3, "token = a7f3k9d2m5q8x1z4", "en", "s"), (4, long, "en", "s")]
    got = s.scan(make(rows)).collect()
    assert sorted((r.doc_id or -1, r.start) for r in got) == [(-1, 8), (3, 8), (3, 8), (4, 1_000_009)]
    want = {(r.doc_id, r.start) for r in s.scan(awkward).collect()}
    assert want == {(d, len(t[:a].encode())) for d, t, _, _ in AWKWARD if t and t.isascii() for a, _ in by_hand(t)}
