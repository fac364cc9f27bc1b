"""Sessions, restarts, timed cards, byte frames, covariance from moments, relative paths."""

import math
import random

import numpy as np
import pytest
from compare import rows as plain_rows, same, tables
from pyspark.sql import functions as F

from rotorlake.functions import scalars as S
from rotorlake.functions.policy import AlertPolicy, Ema
from rotorlake.operators import events, scoring, sequence, session, splits
from rotorlake.plans import queries_eval, queries_session as qs
from rotorlake.sources import stores
from rotorlake.streaming import monitor

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(qs.O))
def test_query_equals_sql(spark, name):
    same(qs.Q[name](spark, SF), tables(SF), qs.O[name])


def test_resampled_values_and_the_sign_of_zero(spark):
    sf = "/root/testdata/sf0.01"
    want = dict(tables(sf).execute(queries_eval.O["resample_linear"]).fetchall())
    got = {r.vec_id: r.resampled for r in queries_eval.Q["resample_linear"](spark, sf).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert [(round(x, 9), math.copysign(1, x)) for x in got[k]] == [(round(x, 9), math.copysign(1, x)) for x in v]


# baseline, store and stream

def distance(a, b):
    n = lambda x: np.asarray(x) / (np.linalg.norm(x) or 1)
    return float(np.clip(1 - n(a) @ n(b), 0, 2))


def knn(v, train):
    return sum(sorted(distance(v, t) for t in train)[:2]) / 2


def session_by_hand(windows):
    head, live = windows[:28], windows[28:]
    train = [v for i, v in enumerate(head) if i % 5 != 4]
    calib = [knn(v, train) for i, v in enumerate(head) if i % 5 == 4]
    ema, alert, out = Ema(), AlertPolicy(n=2, enter=60, leave=30, cooldown=5), []
    for k, v in enumerate(live):
        y = ema.step(knn(v, train))
        out.append(alert.step(100 * sum(c <= y for c in calib) / len(calib), float(28 + k)))
    return out


def test_baseline_is_saved_and_streams_restart_without_gap_or_repeat(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = {s: (rng.normal(0, 0.3, (90, 4)) + [1, 0.5 * s, 0, 0] + np.outer((np.arange(90) // 15) % 3 == 2, [0, 0, 1.5, 0])).tolist() for s in range(3)}
    schema = "stream_id long, seq long, t double, values array<double>"
    table = lambda a, z: spark.createDataFrame([(s, i, float(i), data[s][i]) for s in data for i in range(a, z)], schema)
    fitted = session.fit(table(0, 28))
    fitted.write.parquet(str(tmp_path / "baselines"))
    saved = spark.read.parquet(str(tmp_path / "baselines"))
    assert saved.where("n_windows = 28 and size(calib) = 5 and size(train) = 23").count() == 3

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = monitor.session_states(stream, saved, n=2, enter=60.0, leave=30.0, cooldown=5.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for a, z in ((28, 50), (50, 61), (61, 90)):  # the query ends and starts again between the pieces
        table(a, z).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    run()
    got = sorted((r.stream_id, r.seq, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(s, 28 + k, state) for s in data for k, state in enumerate(session_by_hand(data[s]))]
    assert len({x[2] for x in got}) == 3


def test_short_captures_have_no_baseline(spark):
    rows = [(1, i, [1.0, float(i)]) for i in range(9)] + [(2, i, [1.0, float(i)]) for i in range(10)]
    assert [r.stream_id for r in session.fit(spark.createDataFrame(rows, "stream_id long, seq long, values array<double>")).collect()] == [2]


# cards

def cards_by_timer(cards, interval=2.0):
    """A clock that ticks through all times at which something can happen."""
    shown = at = waiting = None
    out, left = [], sorted(cards)
    while left or waiting is not None:
        due = at + interval if waiting is not None else math.inf
        if left and left[0][0] <= due:
            t, line = left.pop(0)
            if line == shown:
                waiting = None
            elif at is None or t - at >= interval:
                shown, at, waiting = line, t, None
                out.append((t, line))
            else:
                waiting = line
        else:
            shown, at, waiting = waiting, due, None
            out.append((due, shown))
    return out


def test_timed_cards_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(8)
    cards = {s: [(k * 0.5 + rng.choice([0, 0.25]), rng.choice("abc")) for k in range(60) if rng.random() < 0.5] for s in range(4)}
    rows = [(s, i, 1000.0 + t, line) for s, c in cards.items() for i, (t, line) in enumerate(sorted(c))]
    want = sorted((s, t, line) for s, c in cards.items() for t, line in cards_by_timer([(1000.0 + t, x) for t, x in c]))
    table = spark.createDataFrame(rows, "stream_id long, seq long, t double, line string")
    assert sorted(map(tuple, sequence.timed_cards(table).collect())) == want
    timed = table.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    for k in range(3):
        timed.where(f"floor((t - 1000) / 10) = {k}").select("stream_id", "ts", "line").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # a later card of another stream moves the watermark past all timers
    spark.sql("select 99L as stream_id, timestamp_seconds(2000) as ts, 'z' as line").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id long, ts timestamp, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monitor.timed_cards(stream).writeStream.format("memory").queryName("cards").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted(tuple(r) for r in spark.sql("select * from cards where stream_id < 99").collect()) == want


def test_card_states(spark):
    rows = [("ALERT", 99.6, "x" * 80, None), ("SUSPECT", float("nan"), None, None), ("ALERT", None, "", None), ("CAPTURING_BASELINE", None, None, 2.1), ("CAPTURING_BASELINE", None, None, None), ("LOGGED", None, None, None), ("OFFLINE", None, None, None), ("?", 1.0, "e", 1.0), (None, None, None, None)]
    t = spark.createDataFrame(rows, "s string, p double, e string, r double")
    got = [tuple(r) for r in t.coalesce(1).select(*[c.alias(n) for n, c in S.card_lines(F.col("s"), F.col("p"), F.col("e"), F.col("r")).items()]).collect()]
    assert got == [("ALERT P100", "x" * 47 + " | tap to log"), ("Suspect", "tap to log"), ("ALERT", "tap to log"), ("Learning baseline 3 s", "keep the machine running normally"), ("Learning baseline", "keep the machine running normally"), ("Logged", ""), ("Engine offline", "check the connection"), ("", ""), ("", "")]


# frames and paths

def test_frames_are_cut_whatever_the_chunks(spark):
    rng = random.Random(3)
    streams = {1: 101, 2: 64, 3: 31, 4: 79, 5: 0, 6: 80}
    rows, want = [], {}
    for s, n in streams.items():
        data = rng.randbytes(n)
        at = seq = 0
        while at < n:
            z = min(n, at + rng.randint(1, 23))
            rows.append((s, seq, data[at:z]))
            at, seq = z, seq + 1
        even = data[: n // 2 * 2]
        frames = [even[k : k + 32] for k in range(0, len(even), 32)]
        if frames and len(frames[-1]) < 16:
            frames.pop()
        want |= {(s, k): f.ljust(32, b"\0") for k, f in enumerate(frames)}
    got = {(r.stream_id, r.frame_no): bytes(r.data) for r in events.cut_frames(spark.createDataFrame(rows, "stream_id long, seq long, data binary").repartition(3), 32).collect()}
    assert got == want


def test_chunks_and_paths(spark):
    clips = spark.createDataFrame([(1, [float(i) for i in range(23)]), (2, []), (3, [1.0])], "vec_id long, v array<double>")
    got = {(r.vec_id, r.chunk_no): r.v for r in events.chunks_of_clips(clips, 10).collect()}
    assert [len(got[1, k]) for k in range(3)] == [10, 10, 3] and got[3, 0] == [1.0] and len(got) == 4
    t = spark.createDataFrame([("/data/a/b.wav",), ("/database/x.wav",), ("y.wav",), ("/data/",)], "p string").coalesce(1)
    assert [r[0] for r in t.select(S.relative_path(F.col("p"), "/data")).collect()] == ["a/b.wav", "x.wav", "y.wav", ""]


# scores

def test_covariance_scores_from_moments(spark):
    rng = np.random.default_rng(6)
    rows = []
    for m, n in (("a", 200), ("b", 12), ("c", 1)):
        for i in range(n + 20):
            rows.append((len(rows), m, "id", "train" if i < n else "test_normal", (rng.normal(0, 1, 16) * np.arange(1, 17) + 3).tolist()))
    split = spark.createDataFrame(rows, "vec_id long, machine string, machine_id string, split string, v array<double>").repartition(5)
    got = {r.vec_id: r.score for r in scoring.mahalanobis_scores(split, block=7).collect()}
    for m in "ab":
        own = [r for r in rows if r[1] == m]
        train, test = (np.array([r[4] for r in own if (r[3] == "train") == t]) for t in (True, False))
        want = scoring.mahalanobis(train, test)
        assert [got[r[0]] for r in own if r[3] != "train"] == pytest.approx(want.tolist())
    assert len(got) == 40
    with pytest.raises(Exception, match="two train rows"):
        scoring.mahalanobis_scores(split, strict=True).collect()
    assert [(r.machine, r.n_train) for r in scoring.few_train_rows(split, 2).collect()] == [("c", 1)]


def test_split_of_repeated_paths(spark):
    rows = [(i, "fan", "id", "abnormal" if i % 5 == 0 else "normal", f"p{i}", [1.0]) for i in range(30)]
    t = spark.createDataFrame(rows + rows[:3], "vec_id long, machine string, machine_id string, label string, path string, v array<double>")
    got = splits.anomaly_split(t)
    assert got.count() == 33 and plain_rows(["n"], [(got.where("split = 'train'").select("path").distinct().count(),)]) == [(18,)]
    assert {tuple(r) for r in got.groupBy("path").agg(F.countDistinct("split")).select("count(DISTINCT split)").collect()} == {(1,)}
    assert stores is not None
