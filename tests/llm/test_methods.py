"""Operators against brute force, SQL and held-out labels on the small tables."""

import random
import zlib

import numpy as np
import pytest
from brute import alnum, contaminated, near, quality, words
from compare import same, tables

import corpus_pipeline
from rotorlake.llm import decontaminate, license_scan, mixing, near_join, queries, quality as q, token_files
from rotorlake.llm.components import are_stars, components
from rotorlake.llm.near_join import depth_for, least_agreement
from rotorlake.llm.token_files import encoder

SF = "/root/testdata/sf0.001"


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), tables(SF), queries.ORACLES[name])


def test_quality_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op2_quality_rules"](spark, SF).collect()}
    for r in docs(spark).collect():
        g, w = got[r.doc_id], quality(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == w
        assert g.base_failed == (w[0] < 10 or 100 * w[4] > 20 * w[0]) and g.kept <= (not g.base_failed)


def test_near_with_edits(spark, make):
    """Copies with growing edits around the threshold; the forest loses no link of a brute-force join."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        for c in range(8):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), "en", "s"))
    got = sorted(tuple(r) for r in near_join.near_classes(make(rows)).collect())
    want = near([(d, t) for d, t, _, _ in rows])
    assert sum(a[2] for a in got) >= 0.998 * sum(b[2] for b in want)
    assert sum(a == b for a, b in zip(got, want)) >= 0.99 * len(want)
    assert depth_for(0.999, 18, 0.8) == 5 and least_agreement(90, 0.8) > 45


def test_large_group_in_blocks(spark, make, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK_DOCS", 16)
    base = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 190], f"x{i}", *base[i % 190 :]]), "en", "s") for i in range(150)]
    assert sorted(tuple(r) for r in near_join.near_classes(make(rows)).collect()) == near([(d, t) for d, t, _, _ in rows])


def test_components_of_paths_rings_and_stars(spark):
    rng = random.Random(5)
    path, ring, star = list(range(100, 140)), list(range(200, 221)), list(range(300, 340))
    rng.shuffle(path)
    edges = [*zip(path, path[1:]), *zip(ring, [*ring[1:], ring[0]]), *((320, x) for x in star if x != 320)]
    edges += [(400 + rng.randrange(60), 400 + rng.randrange(60)) for _ in range(45)] + edges[:5]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    joined = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root[x]) for x in joined)
    made = spark.createDataFrame([(5, 1), (4, 1), (9, 2)], "a long, b long")
    assert are_stars(made) and sorted(map(tuple, components(made).collect())) == [(1, 1), (2, 2), (4, 1), (5, 1), (9, 2)]
    assert not are_stars(spark.createDataFrame([(5, 4), (4, 1)], "a long, b long"))
    assert not are_stars(spark.createDataFrame([(5, 4), (5, 1)], "a long, b long"))


def test_decontamination_against_all_diagonals(spark, make):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(4)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs(spark).collect()]
    for k, (i, t) in enumerate(bench):
        w = t.split()
        for j in range(7, len(w), 9):  # a word in nine replaced
            w[j] = "zzz"
        a = rng.randint(0, 5) if k % 3 == 0 else 0
        rows.append((10_000 + k, "prefix words here " + " ".join(w[a:]) + " and a tail", "en", "s"))
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(make(rows), items).collect()}
    want = contaminated([r[:2] for r in rows], bench)
    assert got <= want and len(got & want) >= 0.97 * len(want)
    clean = {r[0] for r in rows} - {d for d, _ in want}
    assert not {d for d, _ in got} & clean


def test_license_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op3_license_scan"](spark, "/root/testdata/sf0.01").collect()}
    phrases = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
    for r in docs(spark, "/root/testdata/sf0.01").collect():
        w, at = alnum(r.text), []
        for p, label in phrases:
            p = p.split()
            at += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert set(filter(None, g.base_labels.split(","))) == {x for _, x in at} <= set(g.labels.split(",")) | {""}
        if "CC BY-NC" in r.text:
            assert "cc-by-nc" in g.labels


def test_matching_statistics():
    rng = random.Random(1)
    seqs = [[rng.randrange(4) for _ in range(rng.randint(1, 14))] for _ in range(4)]
    sam = license_scan.SuffixAutomaton(seqs)
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [rng.randrange(5) for _ in range(300)]
    for i, (depth, state) in enumerate(sam.statistics(text)):
        want = max((n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in subs or n == 0), default=0)
        assert depth == want
        for t, end in sam.places[state]:
            if depth:
                assert seqs[t][end - depth + 1 : end + 1] == text[i + 1 - depth : i + 1]


def test_encoder_equals_library():
    import public_tokenizers

    e = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    pieces = [*" \n\t\r.,'\"aébsST0²1_-\xa0\x85\x1c!<|>", "'s", "'ll", "  ", " \u4e2d", "ß", "<|endoftext|>", "\u0301"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(e.encode(t), e.kind).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    rank, toxic = out["score"].rank(), out["toxic"] == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.97 and (out["predicted"][toxic] == 1).mean() > 0.8 and (out["predicted"][~toxic] == 0).mean() > 0.97


def test_pipeline_against_brute_force(spark):
    import public_tokenizers

    rows = {r.doc_id: r for r in docs(spark).collect()}
    # quality: figures by brute force, cutoffs as certified
    measured = q.measure(docs(spark))
    verdict = {r.doc_id: r.kept for r in q.judge(measured, q.joint_thresholds(measured, q.good_documents(spark.read.parquet(f"{SF}/labels.parquet")))).collect()}
    kept = {d for d, r in rows.items() if verdict[d]}
    assert all(quality(rows[d].text)[0] >= 10 for d in kept)
    kept = {d for d, c, _ in near([(d, rows[d].text) for d in sorted(kept)]) if d == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept -= {d for d, _ in contaminated([(d, rows[d].text) for d in kept], bench)}
    con = tables(SF)
    con.execute("create table chosen as select unnest(?) as doc_id", [sorted(kept)])
    con.execute("create table left_docs as select * from documents where doc_id in (select doc_id from chosen)")
    con.execute("drop view documents")
    con.execute("alter table left_docs rename to documents")
    copies = {d: taken // size for d, size, _, _, taken in con.execute(mixing.OP4_SQL).fetchall() if size}
    e = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for d in sorted(copies):
        ids = np.append(np.frombuffer(e.encode(rows[d].text), e.kind), token_files.END_ID).astype("<u4")
        for _ in range(copies[d]):
            want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
    assert len(words(rows[got[0][0]].text)) > 0 and token_files.END_ID == 2
