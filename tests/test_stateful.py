"""Stateful streams against their batch forms, across restarts."""

import random

import pytest
from pyspark.sql import functions as F

from rotorlake.operators import events, session
from rotorlake.streaming import monitor, stateful

BASE = 1_700_000_000


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def run(df, tmp, name):
    """One run over what is there; the next with the same name goes on from its checkpoint."""
    q = df.writeStream.format("parquet").option("path", str(tmp / f"out-{name}")).option("checkpointLocation", str(tmp / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def put(df, tmp, name):
    df.coalesce(1).write.mode("append").parquet(str(tmp / name))


CHUNKS = "stream_id long, seq long, ts timestamp, data binary"


def test_frames_of_any_chunking_over_three_restarts(spark, tmp_path):
    rng = random.Random(8)
    size = 40
    rows, tails = [], {0: 0, 1: 19, 2: 21, 3: 39, 4: 20}
    for s, tail in tails.items():
        left, seq = rng.randbytes(size * 9 + tail), 0
        while left:
            n = rng.choice([0, 1, 3, 7, 50, 130])
            rows.append((s, seq, left[:n]))
            left, seq = left[n:], seq + 1
    at = lambda r: (r[0], r[1], BASE + r[1], r[2])
    cut = max(r[1] for r in rows) // 4 + 1
    frame = lambda part: spark.createDataFrame([at(r) for r in part], "stream_id long, seq long, s long, data binary").select("stream_id", "seq", F.timestamp_seconds("s").alias("ts"), "data")
    for k in range(4):
        part = [r for r in rows if r[1] // cut == k]
        rng.shuffle(part)
        # the last chunk of each run is handed in once more with the next
        part += [r for r in rows if r[1] == k * cut - 1]
        put(frame(part), tmp_path, "in")
        run(stateful.framed(spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in")), size, "1000 seconds", "500 seconds"), tmp_path, "framed")
    put(frame([(99, 0, b"")]).withColumn("ts", F.timestamp_seconds(F.lit(BASE + 9000))), tmp_path, "in")
    for _ in range(2):
        run(stateful.framed(spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in")), size, "1000 seconds", "500 seconds"), tmp_path, "framed")
    got = sorted((r.stream_id, r.frame_no, bytes(r.data)) for r in spark.read.parquet(str(tmp_path / "out-framed")).collect())
    want = events.cut_frames(spark.createDataFrame(rows, "stream_id long, seq long, data binary"), size)
    assert got == sorted((r.stream_id, r.frame_no, bytes(r.data)) for r in want.collect())
    assert {s: sum(g[0] == s for g in got) for s in tails} == {0: 9, 1: 9, 2: 10, 3: 10, 4: 10}


WINDOWS = "stream_id long, seq long, t double, values array<double>"


def test_sessions_hold_their_baseline_in_state(spark, tmp_path):
    rng = random.Random(3)
    fit = [(s, i, [rng.gauss(s, 1) for _ in range(6)]) for s in range(3) for i in range(28)]
    live = [(s, i, float(i), [rng.gauss(s, 1 if i < 20 else 6) for _ in range(6)]) for s in range(4) for i in range(40)]
    baselines = session.fit(spark.createDataFrame(fit, "stream_id long, seq long, values array<double>"))
    policy = {"n": 2, "enter": 80.0, "leave": 40.0, "cooldown": 3.0}
    for k in range(4):
        part = [r for r in live if r[1] // 10 == k]
        put(spark.createDataFrame(part[::-1], WINDOWS), tmp_path, "w")
        known = baselines if k == 0 else baselines.where("false")  # later runs do not need the table
        q = run(stateful.session_scores(spark.readStream.schema(WINDOWS).parquet(str(tmp_path / "w")), known, **policy), tmp_path, "scored")
        if k:
            assert "Join" not in q._jsq.explainInternal(False)
    got = {(r.stream_id, r.seq): r for r in spark.read.parquet(str(tmp_path / "out-scored")).collect()}
    stream = spark.readStream.schema(WINDOWS).parquet(str(tmp_path / "w"))
    stored = tmp_path / "base"
    baselines.write.parquet(str(stored))
    run(monitor.session_states(stream, spark.read.parquet(str(stored)), **policy), tmp_path, "joined")
    want = {(r.stream_id, r.seq): r for r in spark.read.parquet(str(tmp_path / "out-joined")).collect()}
    assert got.keys() == want.keys() and len(got) == 120
    for key, r in want.items():
        assert (got[key].state, got[key].changed) == (r.state, r.changed) and abs(got[key].raw - r.raw) < 1e-9 and abs(got[key].percentile - r.percentile) < 1e-6
    assert {r.state for r in got.values()} == {"LISTENING", "SUSPECT", "ALERT"}


FRAMES = "stream_id long, id long, ts timestamp, raw double"
TAPS = "tap_id long, stream_id long, tap_ts timestamp, at timestamp"


def test_taps_answered_from_a_ring(spark, tmp_path):
    rng = random.Random(5)
    frames = [(s, 100 * s + i, BASE + i, float(rng.randrange(100))) for s in range(3) for i in range(60) if rng.random() < 0.8]
    taps = [(k, rng.randrange(3), t := BASE + rng.randrange(2, 58), t + rng.choice([0, 0, 3, 9])) for k in range(25)]
    stamp = lambda df, *names: df.withColumns({n: F.timestamp_seconds(n) for n in names})
    f = lambda rows: stamp(spark.createDataFrame(rows, "stream_id long, id long, ts long, raw double"), "ts")
    t = lambda rows: stamp(spark.createDataFrame(rows, "tap_id long, stream_id long, tap_ts long, at long"), "tap_ts", "at")
    held = []
    for k in range(5):
        put(f([r for r in frames if (r[2] - BASE) // 15 == k] or [(50, 1, BASE + 500, 0.0)]), tmp_path, "f")
        put(t([r for r in taps if (r[3] - BASE) // 15 == k] or [(99, 50, BASE + 900, BASE + 900)]), tmp_path, "t")
        sources = [spark.readStream.schema(s).parquet(str(tmp_path / p)) for s, p in ((FRAMES, "f"), (TAPS, "t"))]
        run(stateful.tap_answers(*sources, 10), tmp_path, "ring")
        held.append(spark.read.format("statestore").option("stateVarName", "ring").load(str(tmp_path / "c-ring")).count())
    run(stateful.tap_answers(*sources, 10), tmp_path, "ring")
    got = sorted((r.tap_id, r.stream_id, r.frames, r.first_ts, r.last_ts, r.total) for r in spark.read.parquet(str(tmp_path / "out-ring")).collect())
    want = events.tap_evidence(t(taps).select(F.col("tap_id").alias("event_id"), "stream_id", F.col("tap_ts").alias("ts")), f(frames), 10)
    assert got == sorted((r.tap_id, r.stream_id, r.frames, r.first_ts, r.last_ts, r.total) for r in want.collect())
    # twenty seconds behind the watermark and the fifteen of one micro-batch
    assert max(held) <= 3 * 36 and held[-1] <= 2
