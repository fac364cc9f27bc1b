"""Recordings by byte ranges against whole files; stores that a stream keeps."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_signals import wav
from test_stateful import WINDOWS, put, run

from rotorlake.operators import session
from rotorlake.sources import clips, recordings, stores
from rotorlake.streaming import stateful

SR = 16_000


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(recordings.Recordings)
    return spark


def folder(root, names, seed=1):
    rng = np.random.default_rng(seed)
    for name, n, channels in names:
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        data = wav(rng.uniform(-0.9, 0.9, n), channels=channels, pad=b"LIST" + struct.pack("<I", 3) + b"abc\0" if n % 2 else b"")
        at.write_bytes(data + (b"tail" + struct.pack("<I", 5) + b"12345\0" if n % 3 == 0 else b""))


def whole(rows):
    out = {}
    for r in sorted((r for r in rows if r.error is None), key=lambda r: (r.path, r.chunk_no)):
        got = out.setdefault(r.path.rsplit("/", 1)[1], [])
        assert r.chunk_no == len(got)
        got.append(np.array(r.samples, np.float32))
    return {k: np.concatenate(v) for k, v in out.items()}


NAMES = [("fan/id_00/normal/a.wav", 48_123, 1), ("fan/id_00/normal/b.wav", 16_000, 2), ("fan/id_00/abnormal/c.wav", 7, 1), ("fan/id_00/abnormal/d.wav", 33_333, 3)]


@pytest.mark.parametrize("most", [999, 30_000, 1 << 26])
def test_ranges_of_any_size_equal_decoded_files(source, tmp_path, most):
    folder(tmp_path / "0dB", NAMES)
    (tmp_path / "0dB/fan/id_00/normal/bad.wav").write_bytes(b"nothing that sounds")
    df = source.read.format("recordings").option("chunk_s", 0.25).option("partition_bytes", most).load(str(tmp_path / "0dB"))
    rows = df.collect()
    read = clips.read_clips(source, clips.list_clips(source, str(tmp_path), "0dB"), str(tmp_path)).collect()
    want = {r.path.rsplit("/", 1)[1]: np.array(r.samples, np.float32) for r in read if r.error is None}
    got = whole(rows)
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)
    assert [r.error for r in rows if r.error] == ["not a RIFF/WAVE file"] and max(len(r.samples or ()) for r in rows) == SR // 4
    assert df.rdd.getNumPartitions() == 1 if most == 1 << 26 else df.rdd.getNumPartitions() > 5


def test_an_empty_folder_and_a_missing_one(source, tmp_path):
    assert source.read.format("recordings").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        source.read.format("recordings").load(str(tmp_path / "nowhere")).count()


def test_a_growing_file_over_restarts(source, tmp_path):
    root = tmp_path / "in"
    folder(root, [("a.wav", 40_001, 1), ("b.wav", 8_000, 1)])
    full = {p.name: p.read_bytes() for p in root.iterdir()}
    seen = []
    for share in (0.0, 0.3, 0.31, 0.8, 1.0):
        for name, data in full.items():
            (root / name).write_bytes(data[: int(len(data) * share)])
        run(source.readStream.format("recordings").option("chunk_s", 0.5).load(str(root)), tmp_path, "rec")
        rows = source.read.parquet(str(tmp_path / "out-rec")).collect()
        seen.append(sum(r.path.endswith("a.wav") and r.error is None for r in rows))
    batch = source.read.format("recordings").option("chunk_s", 0.5).load(str(root)).collect()
    assert sorted((r.path, r.chunk_no, tuple(r.samples)) for r in rows) == sorted((r.path, r.chunk_no, tuple(r.samples)) for r in batch)
    assert seen == [0, 1, 1, 3, 6]


def test_a_store_is_written_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(list(r), "tag string, version long, x double")
    write = stores.write_once(path, "tag", "version", "q")
    held = lambda: sorted((r.tag, r.version, r.x) for r in spark.read.option("basePath", path).parquet(path).collect())
    first = rows(("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 3.0), ("b", 1, 4.0))
    write(first, 0)
    assert held() == [("a", 2, 2.0), ("a", 2, 3.0), ("b", 1, 4.0)]
    # a crash after the rows were written, before the ledger: the batch comes again
    second = rows(("b", 5, 5.0), ("c", 1, 6.0))
    stores.replace(second.where("tag = 'b'"), path, "tag")
    write(second, 1)
    done = [("a", 2, 2.0), ("a", 2, 3.0), ("b", 5, 5.0), ("c", 1, 6.0)]
    assert held() == done
    for batch, number in ((first, 0), (second, 1)):  # replays
        write(batch, number)
        assert held() == done
    stores.write_once(path, "tag", "version", "another")(rows(("a", 9, 9.0)), 0)
    assert held() == [("a", 9, 9.0), *done[2:]]


def test_saved_tags_enter_a_live_session(spark, tmp_path):
    rng = random.Random(6)
    path = str(tmp_path / "tags")
    fit = spark.createDataFrame([(s, i, [rng.gauss(s, 1) for _ in range(4)]) for s in range(2) for i in range(28)], "stream_id long, seq long, values array<double>")
    saved = session.fit(fit).withColumns({"tag": F.concat(F.lit("press-"), F.col("stream_id").cast("string")), "version": F.lit(1).cast("long")})
    saved.write.parquet(str(tmp_path / "fits"))
    stream = spark.readStream.schema(saved.schema).parquet(str(tmp_path / "fits"))
    for _ in range(2):
        q = stores.keep(stream, path, "tag", "version", "tags", str(tmp_path / "c-tags"), stores.save_baseline)
        q.awaitTermination(120)
        assert q.exception() is None
    assert [r.tag for r in stores.tags(spark.read.parquet(path)).collect()] == ["press-0", "press-1"]
    sessions = spark.createDataFrame([(70, "press-1"), (71, "press-0"), (72, "press-1")], "stream_id long, tag string")
    put(spark.createDataFrame([(s, i, float(i), [rng.gauss(0, 1) for _ in range(4)]) for s in (70, 71, 72) for i in range(6)], WINDOWS), tmp_path, "live")
    stateful.use_rocksdb(spark)
    run(stateful.session_scores(spark.readStream.schema(WINDOWS).parquet(str(tmp_path / "live")), stores.baselines_of(sessions, path)), tmp_path, "live")
    got = spark.read.parquet(str(tmp_path / "out-live")).collect()
    assert {r.stream_id for r in got} == {70, 71, 72} and len(got) == 18
    want = session.raw_scores(spark.read.parquet(str(tmp_path / "live")), stores.baselines_of(sessions, path)).collect()
    assert all(abs(r.raw - next(g.raw for g in got if (g.stream_id, g.seq) == (r.stream_id, r.seq))) < 1e-9 for r in want)
    with pytest.raises(Exception, match="no baseline named nobody"):
        stores.baselines_of(spark.createDataFrame([(1, "nobody")], "stream_id long, tag string"), path).collect()
