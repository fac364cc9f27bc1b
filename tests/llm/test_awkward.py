"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing names."""

import zlib

import numpy as np
import pytest
from brute import alnum, near, quality, words
from conftest import AWKWARD

from rotorlake.llm import decontaminate, license_scan, mixing, near_join, quality as q, secrets_scan, token_files, toxicity, url_filter, warc
from rotorlake.llm.token_files import Reader, Writer, decode_block, encode_block


def test_quality_figures(awkward):
    got = sorted((tuple(r) for r in q.measure(awkward).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=repr)
    assert got == sorted(((d, *quality(t)) for d, t, _, _ in AWKWARD), key=repr)


def test_quality_without_labels(spark, awkward, empty):
    none = q.good_documents(spark.createDataFrame([], "doc_id long, quality int"))
    m = q.measure(awkward)
    out = {r.doc_id: r.kept for r in q.judge(m, q.thresholds(m, none)).collect()}
    assert out[10] and not out[0] and not out[5]
    assert q.judge(q.measure(empty), q.thresholds(q.measure(empty), none)).count() == 0


def test_certified_cutoffs():
    assert q.binomial_tail(0, 10, 0.5) == pytest.approx(0.5**10) and q.binomial_tail(10, 10, 0.5) == 1
    # the upper bound of 0 of n at 5 %: 1 - 0.05 ** (1 / n), within 2 % from n = 149 on
    assert q.certified(148, [0], 0.02, 0.05) == 0 and q.certified(149, [0], 0.02, 0.05) == 1
    assert q.certified(1000, [0, 5, 30, 0], 0.02, 0.05) == 2 and q.certified(0, [0], 0.02, 0.05) == 0


def test_quality_keeps_its_promise(spark):
    """Rejections of good documents stay within the limit for every stratum, over many draws."""
    rng = np.random.default_rng(5)
    broken = 0
    for _ in range(200):
        x = rng.exponential(10, 2000)
        cuts = q.RULES["symbols_per_100_words"]
        k = q.certified(500, [int((x[:500] > c).sum()) for c in cuts], 0.02, 0.05)
        broken += k > 0 and np.exp(-cuts[k - 1] / 10) > 0.02
    assert broken <= 20


def test_license(awkward, empty):
    rows = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(awkward).collect()}
    want = set()
    for d, t, _, _ in AWKWARD:
        w = alnum(t)
        at = [i for i in range(len(w) - 1) if w[i : i + 2] == ["mit", "license"]]
        want.add((d, len(w), len(at), at[0] if at else None, at[-1] if at else None, "mit" if at else ""))
    assert rows == want
    assert license_scan.scan(empty).count() == 0


def test_mixing(awkward, empty):
    out = mixing.mix(awkward).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.taken <= 3 * r.size for r in out)
    assert {r.doc_id: r.size for r in out}[7] == len(words(AWKWARD[8][1]))
    assert sum(r.taken for r in out) <= sum(r.size for r in out)
    assert mixing.mix(empty).count() == 0


def test_tokens(spark, awkward, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.tokens(awkward).collect()), key=lambda r: r[1])
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for d, x, _, _ in AWKWARD}
    assert [r[0] for r in got] == sorted((d for d, *_ in AWKWARD), key=lambda d: (d is not None, d))
    at = 0
    for d, start, n, crc in got:
        assert (start, n, crc) == (at, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        at += n
    assert token_files.tokens(empty).count() == 0


def test_near(awkward, empty):
    got = sorted(tuple(r) for r in near_join.near_classes(awkward).where("doc_id is not null").collect())
    assert got == near([(d, t) for d, t, _, _ in AWKWARD])
    assert near_join.near_classes(awkward).where("doc_id is null and class_id is null and n_links = 0").count() == 1
    assert near_join.near_classes(empty).count() == 0


def test_decontamination(spark, awkward, empty):
    items = spark.createDataFrame([(1, AWKWARD[-1][1]), (2, None), (3, ""), (None, "x y z"), (4, "one two three"), (5, LONG_PART)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(awkward, items).collect()}
    assert got == {(10, 1), (5, 4), (6, 4), (10, 4), (4, 5)}
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(awkward, items.where("item_id = 99")).count() == 0


LONG_PART = " ".join(AWKWARD[4][1].split()[100_000:100_040])


def test_toxicity(spark, awkward, empty):
    labels = spark.createDataFrame([(10, 0), (8, 0), (9, 1), (9, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    w, b = toxicity.train(awkward, labels)
    rows = {r.doc_id: r for r in toxicity.score(awkward, w, b).collect()}
    assert len(rows) == len({d for d, *_ in AWKWARD}) and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[0].score == rows[1].score == 0 and rows[9].score > rows[10].score
    w, b = toxicity.train(empty, labels)
    assert toxicity.score(empty, w, b).count() == 0 and toxicity.score(awkward, w, b).where("score > 0.001").count() == 0


def test_secrets(spark, make, empty):
    key = "AKIA" + "Q7ZP" * 4
    rows = [(i, f"some words and password=a9f3b2c4d5e6f7a{i:04x} then more and loooooooooongwordhere{'abc' * (i % 3)} {key if i % 5 == 0 else ''}", "en", "s") for i in range(120)]
    out = secrets_scan.scan(make(rows + [(None, key, None, None), (500, None, None, None)])).collect()
    assert sum(r.is_secret == r.by_rule for r in out) > 0.95 * len(out) and any(r.is_secret for r in out)
    assert secrets_scan.scan(empty).count() == 0
    assert secrets_scan.scan(make([(1, "x" * 40, "en", "s")])).head().is_secret is False


def test_urls(spark):
    urls = ["http://a.EXAMPLE.net/en/1?x#y", "http://net/", "http://net", "http://xnet/a", None, "no scheme/net/", "https://b.example.com/de/1", "https://b.example.com/dee", "ftp://q.org/fr/", "http://example.net/en", "a://b://c.net/d", "http://h\n.net/p"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as rule", "'y' as host")
    a = url_filter.judge(rows)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in a.collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1][2:] == ("net/", "block") and got[2] == ("net", "", None, "allow")
    assert got[4] == ("", "", None, "allow") == got[5] and got[6][2:] == ("example.com/de/", "block") and got[7][2:] == (None, "allow")
    assert got[8][2:] == ("org/fr/", "allow") and got[9][2:] == ("net/", "block") and got[10][0] == "b:" and got[11][0] == "h\n.net"
    b = url_filter.judge(rows, max_trie_bytes=0)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in b.collect()} == got
    assert url_filter.judge(rows.where("page_id < 0")).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://c/", None), (None, "http://d/", "x"), (5, "http://e\r\n/", "\r\n\r\nWARC/1.1\r\n"), (6, "u", "é" * 300_000), (7, "u", ""), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    raw = warc.write_archives(pages, warc.new_folder(spark, "t"), archive_bytes=1000)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.normalise(raw)).collect()), key=repr)
    want = []
    for k, _, h in rows:
        group = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        last = max(group)
        want.append((k, len((h or "").encode()), warc.digest((h or "").encode()), "response" if k == last else "revisit", None if k == last else last))
    assert got == sorted(want, key=repr)
    assert warc.read_archives(warc.normalise(warc.write_archives(pages.where("page_id < 0"), warc.new_folder(spark, "t")))).count() == 0


@pytest.mark.parametrize("ids", [[0], [2**32 - 1, 0], [7] * 5000, list(range(5000)), [1, 2, 3, 2**31] * 900])
def test_blocks(ids, tmp_path):
    ids = np.array(ids, np.uint32)
    assert np.array_equal(decode_block(encode_block(ids)), ids)
    with open(tmp_path / "f", "w+b") as f:
        w = Writer(f)
        for k in range(4):
            w.add(k, ids[: len(ids) * k // 3])
        w.close()
        r = Reader(f, f.tell())
        assert [(k, x.tolist()) for k, x in r.documents(step=1000)] == [(k, ids[: len(ids) * k // 3].tolist()) for k in range(4)]
