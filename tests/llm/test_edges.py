"""Hot keys, damaged archives, other tokenizers, licence spans."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import table

from rotorlake.llm import license_scan as ls, mixing, token_files as tf, url_filter, warc
from rotorlake.llm.common import new_folder
from rotorlake.llm.files import open_fs


def test_chains_take_linear_time():
    s = ls.Scanner()
    words = ls.template_words(ls.TEMPLATES["bsd-text"])
    took = []
    for n in (200, 800):
        ids = np.array([s.ids[w] for w in words * n])
        at = time.perf_counter()
        best, found = s.spans(ids)
        took.append(time.perf_counter() - at)
        assert sum(x["template"] == "bsd-text" and x["cover"] == 1 for x in found) == n
    assert took[1] < 10 * took[0]


def test_anchors_of_every_template_against_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        seqs = [[rng.randrange(3) for _ in range(rng.randint(2, 12))] for _ in range(3)]
        text = [rng.randrange(4) for _ in range(40)]
        sam = ls.SuffixAutomaton(seqs)
        got = set(sam.anchors(text, 2))
        want = set()
        for t, s in enumerate(seqs):
            for i in range(len(text)):
                for j in range(len(s)):
                    n = 0
                    while i + n < len(text) and j + n < len(s) and text[i + n] == s[j + n]:
                        n += 1
                    if n >= 2 and not (i and j and text[i - 1] == s[j - 1]):
                        want.add((i, n, t, j))
        # an occurrence that a longer one at another place of the same template contains may stand for it with its length
        assert {(i + n, t, j + n) for i, n, t, j in want} == {(i + n, t, j + n) for i, n, t, j in got}
        assert got == want


def test_licence_texts_and_spans(spark, make):
    body = ls.TEMPLATES["mit-text"].split()
    changed = [*body[:60], "acme", "corp", *body[60:]]
    text = "head words " + " ".join(changed) + " middle " + ls.TEMPLATES["isc-text"] + " tail of words released under the mit license and again released under the mit license"
    r = ls.scan(make([(1, text, "en", "s"), (1, text, "en", "s"), (None, None, None, None)])).collect()
    assert [x.labels for x in r].count("isc,mit") == 2 and [x.score for x in r if x.doc_id is None] == [0.0]
    spans = {(x.template, x["first"], x.words) for x in r[0].spans} if r[0].doc_id else {(x.template, x["first"], x.words) for x in r[1].spans}
    assert ("mit-text", 2, len(body) + 2) in spans and sum(t == "mit" for t, _, _ in spans) == 2
    assert any(t == "isc-text" for t, _, _ in spans)


def test_damaged_archives_are_errors(spark):
    pages = spark.createDataFrame([(k, "http://a/", f"page {k} " * 50) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, new_folder(spark, "cut"))
    path = manifest.head().path
    store, local = open_fs(path)
    whole = store.open_input_stream(local, compression=None).read()
    inflated = zlib.decompress(whole, 31)
    border = inflated.index(b"WARC/1.1", 20)
    gz = zlib.compressobj(6, wbits=31)
    at_border = gz.compress(inflated[:border]) + gz.flush(zlib.Z_SYNC_FLUSH)
    gz = zlib.compressobj(6, wbits=31)
    ended = gz.compress(inflated[:border]) + gz.flush()
    for damaged in (at_border, whole[:-20], ended):
        with store.open_output_stream(local, compression=None) as out:
            out.write(damaged)
        with pytest.raises(Exception, match="ends within|records of"):
            warc.normalise(manifest)


def test_pages_with_extra_columns(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string").selectExpr("*", "1 as refers_to", "2 as sha", "3 as n")
    got = warc.read_archives(warc.normalise(warc.write_archives(pages, new_folder(spark, "extra")))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "revisit", 2), (2, "response", None)]


def test_very_long_url(spark):
    url = "http://" + ".".join(["a"] * 5000) + ".net/" + "/".join(["p"] * 100_000)
    r = url_filter.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).head()
    assert (r.rule, r.verdict, len(r.path)) == ("net/", "block", 200_000)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_tokenizers(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    e, t = tf.Encoder(path), Tokenizer.from_file(path)
    for text in ("Hello  World's end\n\n 12 Zwölf", "", "  a\tb ", "x<|endoftext|>y", "Ünï 中文 ok"):
        assert np.frombuffer(e.encode(text), e.kind).tolist() == t.encode(text, add_special_tokens=False).ids


def test_hot_ids_are_spread(spark, make):
    rows = [(7, f"text number {i} of a hot id", "en", "s") for i in range(300)] + [(i, f"other {i}", "en", "s") for i in (1, 2, 9, 12)]
    docs = make(rows)
    n, bounds = tf.ranges(docs.select("doc_id", "text"))
    tie = np.sort(np.random.default_rng(1).integers(0, 1 << 32, 1000))
    part = tf.part_of(np.full(1000, 7), tie, bounds)
    assert n == 4 and len(set(part.tolist())) == 3 and (np.diff(part) >= 0).all()
    assert (tf.part_of(np.array([1, 2]), tie[:2], bounds) <= part[0]).all() and (tf.part_of(np.array([9, 12]), tie[:2], bounds) > part[-1]).all() or part[-1] <= n - 1
    got = sorted(tf.tokens(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(d for d, *_ in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_hot_slices_give_the_same_mix(spark, monkeypatch):
    rows = [(5 if i % 3 else None, " ".join(["w"] * (1 + i % 7)) + f" x{i}", "en", "ab"[i % 2]) for i in range(400)]
    docs = table(spark, rows)
    monkeypatch.setattr(mixing, "HOT_ROWS", 20)
    got = mixing.mix(docs).collect()
    again = {(r.doc_id, r.t1, r.source): r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert len(got) == 400 and {(r.doc_id, r.t1, r.source): r.taken for r in got} == again
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 20 and all(r.taken <= 3 * r.size for r in mine)


def test_word_counts(spark, make):
    texts = [None, "", " \t\n", "a", " a ", "a\nb\x0bc\x0cd\re  f", "é　x y", "x" * 100_000]
    got = {r.doc_id: r.n for r in make([(i, t, None, None) for i, t in enumerate(texts)]).select("doc_id", mixing.n_words(mixing.F.col("text")).alias("n")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 6, 6: 2, 7: 1}
