from pyspark.sql import functions as F

from rotorlake.functions.policy import AlertPolicy, Ema
from rotorlake.streaming import monitor


def drain(df, tmp, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_stateful_scores_equal_a_plain_fold(spark, tmp_path):
    rows = [(s, i, float(i + 1), float((i * 37 + s * 11) % 101)) for i in range(60) for s in range(3)]
    for k in range(4):
        part = [r for r in rows if r[1] // 15 == k]
        spark.createDataFrame(part[::-1], "stream_id long, seq long, t double, raw double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calib = spark.createDataFrame([(s, [float(x) for x in range(0, 100, 7)]) for s in range(3)], "stream_id long, calib array<double>")
    stream = spark.readStream.schema("stream_id long, seq long, t double, raw double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    got = {(r.stream_id, r.seq): (r.state, r.ema) for r in drain(monitor.scored(stream, calib, n=2, enter=60.0, leave=30.0, cooldown=5.0), tmp_path, "scored")}
    assert len(got) == 180
    for s in range(3):
        ema, alert = Ema(), AlertPolicy(n=2, enter=60, leave=30, cooldown=5)
        for r in (r for r in rows if r[0] == s):
            y = ema.step(r[3])
            p = 100.0 * sum(c <= y for c in range(0, 100, 7)) / 15
            assert got[s, r[1]] == (alert.step(p, r[2]), y)


def test_windows_and_taps(spark, tmp_path):
    base = 1_700_000_000
    rows = spark.range(12).selectExpr("id % 1 as stream_id", "id as event_id", f"timestamp_seconds({base} + id) as ts", "cast(id as double) as raw")
    rows.where("event_id <> 5").coalesce(1).write.parquet(str(tmp_path / "f"))
    schema = "stream_id long, event_id long, ts timestamp, raw double"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "f"))
    got = drain(monitor.full_windows(stream(), late="0 seconds"), tmp_path, "wins")
    assert all(len(r["values"]) == 3 and 5.0 not in r["values"] for r in got) and len(got) >= 4
    spark.createDataFrame([(1, 0, base + 8)], "tap_id long, stream_id long, s long").select("tap_id", "stream_id", F.timestamp_seconds("s").alias("tap_ts")).write.parquet(str(tmp_path / "t"))
    taps = spark.readStream.schema("tap_id long, stream_id long, tap_ts timestamp").parquet(str(tmp_path / "t"))
    found = drain(monitor.taps_with_frames(taps, stream(), 4), tmp_path, "tapped")
    assert sorted(r.frame_id for r in found) == [4, 6, 7, 8]
