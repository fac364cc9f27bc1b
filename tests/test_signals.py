import struct

import numpy as np
import pytest

from rotorlake.functions import dsp
from rotorlake.operators import features
from rotorlake.sources import clips, stores

SR = dsp.SR


def wav(x, sr=SR, channels=1, claim=None, pad=b""):
    pcm = np.repeat((np.asarray(x) * 32767).astype("<i2"), channels).tobytes()
    fmt = struct.pack("<HHIIHH", 1, channels, sr, sr * 2 * channels, 2 * channels, 16)
    body = b"WAVE" + pad + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", claim or len(pcm)) + pcm
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav():
    x = np.sin(np.arange(1000) / 9) / 2
    for data in (wav(x), wav(x, channels=2), wav(x, claim=1 << 30), wav(x, pad=b"LIST" + struct.pack("<I", 3) + b"abc\0")):
        assert np.abs(dsp.decode_wav(data) - x).max() < 1e-4
    with pytest.raises(dsp.BadAudio):
        dsp.decode_wav(wav(x, sr=8000))
    with pytest.raises(dsp.BadAudio):
        dsp.decode_wav(b"nothing")


def test_logmel_shape_and_peak():
    assert dsp.logmel(np.zeros(SR * 10)).shape == (64, 313) and dsp.logmel(np.zeros(SR)).shape == (64, 32)
    m = dsp.logmel(np.sin(2 * np.pi * 1000 * np.arange(SR) / SR)).mean(axis=1)
    edges = dsp.mel_edges()
    k = int(m.argmax())
    assert edges[k] < 1000 < edges[k + 2]


@pytest.mark.parametrize("hz", [30, 90, 120])
def test_burst_train(hz):
    rng = np.random.default_rng(0)
    t = np.arange(3 * SR) / SR
    x = 0.02 * rng.normal(size=len(t)) + np.sin(2 * np.pi * 2500 * t) * np.exp(-((t * hz) % 1) * 6)
    peaks = dsp.envelope_peaks(x)
    assert abs(peaks[0][0] - hz) < 2


def test_align_mix_transfer():
    rng = np.random.default_rng(2)
    ref = rng.normal(size=4000)
    rec = np.concatenate([np.zeros(731), ref / 2, np.zeros(900)]) + rng.normal(size=5631) * 0.01
    lag, peak = dsp.align(rec, ref)
    assert lag == 731 and peak > 0.9
    clean, noise = np.sin(np.arange(SR) / 5) / 4, rng.normal(size=3000)
    for snr in (0, 5, 10):
        out = dsp.mix_at_snr(clean, noise * 0.01, snr, 1)
        assert abs(10 * np.log10(np.mean(clean**2) / np.mean((out - clean) ** 2)) - snr) < 0.5
    assert np.array_equal(dsp.mix_at_snr(clean, noise, 5, 3), dsp.mix_at_snr(clean, noise, 5, 3))
    with pytest.raises(ValueError):
        dsp.mix_at_snr(clean * 0, noise, 5, 3)
    sweep = dsp.log_sweep(4, 100, 7000)
    f, db = dsp.transfer(sweep * 0.5, sweep)
    inside = (f > 300) & (f < 6000)
    assert np.abs(db[inside] + 6.02).max() < 1


def test_clip_listing_and_decoding(spark, tmp_path):
    for m in ("fan", "pump"):
        for lab in ("normal", "abnormal"):
            d = tmp_path / "0dB" / m / "id_00" / lab
            d.mkdir(parents=True)
            for k in range(2):
                (d / f"{k:08}.wav").write_bytes(wav(np.full(SR, 0.25)))
    (tmp_path / "0dB/fan/id_00/normal/bad.wav").write_bytes(b"junk")
    rows = clips.list_clips(spark, str(tmp_path), "0dB")
    got = [(r.machine, r.label) for r in rows.collect()]
    assert len(got) == 9 and got == sorted(got)
    read = clips.read_clips(spark, rows, str(tmp_path))
    assert read.where("error is not null").count() == 1
    v = features.features(read, "pooled").where("error is null").head()
    assert len(v.embedding) == 128
    windows = features.clip_windows(read.where("error is null").limit(1), SR // 2, SR // 4)
    assert windows.count() == 3
    with pytest.raises(KeyError):
        features.features(read, "nothing")
    with pytest.raises(Exception):
        clips.list_clips(spark, str(tmp_path), "6dB").collect()


def test_table_function(spark):
    features.register_sql(spark)
    got = spark.sql("select window_no, size(w.samples) n from (select array(1f,2f,3f,4f,5f) as x) t, lateral slice_windows(t.x, 3, 1) w").collect()
    assert [tuple(r) for r in got] == [(0, 3), (1, 3), (2, 3)]


def test_stores(spark, tmp_path):
    p = str(tmp_path / "b")
    make = lambda tag, n: spark.range(n).selectExpr("id as row_no", f"'{tag}' as tag")
    stores.save_baseline(make("a", 3).union(make("b", 2)), p)
    stores.save_baseline(make("a", 5), p)
    assert stores.load_baseline(spark, p, "a").count() == 5 and stores.load_baseline(spark, p, "b").count() == 2
    assert [r.tag for r in stores.tags(spark.read.parquet(p)).collect()] == ["a", "b"]
    with pytest.raises(KeyError):
        stores.load_baseline(spark, p, "c")
    with pytest.raises(Exception, match="not a tag"):
        stores.save_baseline(make("..//evil", 1), p)
