"""Line runs against counting in plain Python."""

import hashlib
import random
from collections import defaultdict

from compare import same, tables
from conftest import AWKWARD
from pyspark.sql import functions as F

from rotorlake.llm import line_dedup as ld
from rotorlake.llm.common import new_folder

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, min_points=20, min_docs=3):
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            k, ids = key(x), held[key(x)]
            newest = max((j for j in ids if j is not None), default=None)
            if not (len(k) >= min_points and len(ids) >= min_docs and newest is not None and (i is None or i < newest)):
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept) if kept else None))
    return sorted(out, key=repr)


def got(df, **kw):
    return sorted((tuple(r) for r in ld.dedup_lines(df, **kw).collect()), key=repr)


def test_query_equals_sql(spark):
    same(ld.op12_line_dedup(spark, SF), tables(SF), ld.OP12_SQL)


def test_awkward_rows(make, awkward, empty):
    assert got(awkward) == brute([r[:2] for r in AWKWARD])
    assert got(empty) == []
    line = "A line of more than twenty points"
    rows = [(1, line), (2, f"\t{line.upper()}\r\nother\n\n{line}"), (2, line), (3, f" \x0b{line}\n{line} "), (None, line), (4, "ÀÉ 　 " * 8), (4, "ÀÉ 　 " * 8), (5, "　" * 25), (6, "àé 　 " * 8)]
    rows += [(9, f"{line}x"), (9, f"{line}x"), (9, f"{line}x"), (None, "nobody has an id for this"), (None, "nobody has an id for this"), (None, "nobody has an id for this")]
    assert got(make([(*r, "en", "s") for r in rows])) == brute(rows)


def test_random_texts_in_any_number_of_batches(make):
    rng = random.Random(12)
    pool = [f"line number {i} of a common pool" for i in range(12)] + ["short", "", " " * 30]
    rows = [(rng.choice([None, *range(40)]), "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 9)))) for _ in range(150)]
    df = make([(*r, "en", "s") for r in rows])
    for n in (1, 2, 5):
        assert got(df, batches=n, min_docs=n + 1) == brute(rows, min_docs=n + 1)


def test_long_text_stays_linear(make):
    text = "\n".join(["a line that is found in every text", *(f"line {i} of a very long text" for i in range(60_000)), "a line that is found in every text" + " " * 200_000])
    rows = [(i, text) for i in range(3)]
    assert got(make([(*x, "en", "s") for x in rows])) == brute(rows)


def test_runs_merge_by_level_and_open_again(spark):
    folder = new_folder(spark, "runs")
    runs = ld.LineRuns(spark, folder, min_docs=3)
    held = defaultdict(list)
    rng = random.Random(3)
    sizes = []
    for batch in range(7):
        # keys 0 to 9 are in every batch, so from the third on only larger ids bring them back
        rows = [(k, 0, 100 - batch) for k in range(10)] + [(rng.randint(10, 60), batch % 2, 100 - batch) for _ in range(20)]
        rows = list(dict.fromkeys(rows))
        for a, b, d in rows:
            held[a, b].append(d)
        df = spark.createDataFrame(rows, "h1 long, h2 long, doc_id long")
        if batch == 4:
            runs = ld.LineRuns.open(spark, folder)  # as another driver would
        new = {(r.h1, r.h2) for r in runs.unsettled(df).collect()}
        assert (new & {(k, 0) for k in range(10)} == set()) == (batch >= 3)
        runs.add(df)
        sizes.append([len(x) for x in runs.levels])
    assert sizes[:4] == [[1], [0, 1], [1, 1], [0, 0, 1]] and sizes[6] == [1, 1, 1]
    later = runs.unsettled(spark.createDataFrame([(1, 0, 500), (2, 0, 5)], "h1 long, h2 long, doc_id long")).collect()
    assert [(r.h1, r.newest) for r in later] == [(1, 500)]
    assert {(r.h1, r.h2): r.newest for r in runs.frequent().collect()} == {k: max(v) for k, v in held.items() if len(v) >= 3}
    assert len(runs.names()) == 1


def test_a_run_joins_without_moving_it(spark):
    runs = ld.LineRuns(spark)
    lines = spark.range(2000).select((F.col("id") % 700).alias("h1"), (F.col("id") % 7).alias("h2"), F.col("id").alias("doc_id"))
    runs.add(lines)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for runs that are not small
    try:
        plan = runs.unsettled(lines)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_digest_of_kept_text(spark):
    r = {x.doc_id: x for x in ld.op12_line_dedup(spark, SF).collect()}
    texts = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for i, n, dropped, kept in brute(texts):
        assert (r[i].n_lines, r[i].n_dropped, r[i].kept_sha256) == (n, dropped, hashlib.sha256((kept or "").encode()).hexdigest())
