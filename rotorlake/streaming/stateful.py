"""Stateful operators on ``transformWithState``: frames from chunks, sessions that hold their baseline, rings for taps.

They need the RocksDB state store (``use_rocksdb``).  Each deals its rows by stream once; state is a remainder of under a
frame, a model and five numbers, or the last seconds of frames.  Timers run on event time, so a restart from the
checkpoint goes on where the last finished micro-batch ended.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.policy import AlertPolicy, Ema
from .monitor import OUT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these operators need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def gathered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


def ms(ts: pd.Timestamp) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class Framer(StatefulProcessor):
    """Chunks of a stream in order of seq; what is left of a frame waits in state until more comes or the stream falls silent."""

    def __init__(self, frame_bytes: int, idle_ms: int):
        self.size, self.idle = frame_bytes, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rest = handle.getValueState("rest", "data binary, frames long, seq long, due long")

    def frames(self, key: tuple, first: int, data: bytes) -> pd.DataFrame:
        cut = [data[i : i + self.size] for i in range(0, len(data), self.size)]
        return pd.DataFrame({"stream_id": [key[0]] * len(cut), "frame_no": range(first, first + len(cut)), "data": cut}).astype({"frame_no": "int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, done, last, due = self.rest.get() if self.rest.exists() else (b"", 0, None, None)
        pdf = gathered(rows, ["seq"])
        # a chunk that is handed in again, or comes after its successor was framed, has had its turn
        pdf = pdf[pdf["seq"] > (-1 if last is None else last)].drop_duplicates("seq")
        if pdf.empty:
            return
        data = bytes(rest) + b"".join(bytes(x) for x in pdf["data"] if x is not None)
        whole = len(data) // self.size * self.size
        if due is not None:
            self.handle.deleteTimer(due)
        due = max(ms(pdf["ts"].max()), (due or 0) - self.idle) + self.idle
        self.handle.registerTimer(due)
        self.rest.update((data[whole:], done + whole // self.size, int(pdf["seq"].max()), due))
        yield self.frames(key, done, data[:whole])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rest, done, last, _ = self.rest.get()
        even = bytes(rest)[: len(rest) // 2 * 2]
        padded = len(even) >= self.size // 2 and len(even) > 0
        self.rest.update((b"", done + padded, last, None))
        if padded:
            yield self.frames(key, done, even.ljust(self.size, b"\0"))

    def close(self) -> None:
        pass


def framed(chunks: DataFrame, frame_bytes: int = 32_000, idle: str = "5 seconds", late: str = "0 seconds") -> DataFrame:
    """stream_id, frame_no, data: frames of ``frame_bytes`` from a stream of chunks(stream_id, seq, ts, data) cut anyhow.

    When the watermark passes ``idle`` after a stream's last chunk, a tail of half a frame or more is padded with zeros and comes out once; a
    shorter tail, and an odd last byte, are left out.  Chunks repeated, or older than the last one framed, add nothing.
    Null data is an empty chunk.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return chunks.select("stream_id", "seq", "ts", "data").withWatermark("ts", late).groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=Framer(frame_bytes, idle_ms), outputStructType="stream_id long, frame_no long, data binary", outputMode="Append", timeMode="EventTime"
    )


class SessionScorer(StatefulProcessor):
    """Windows of a stream against its own baseline, which came once as initial state."""

    def __init__(self, alpha: float, k: int, policy: Callable[[], Policy]):
        self.alpha, self.k, self.policy = alpha, k, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "train array<double>, n int, calib array<double>")
        self.fold = handle.getValueState("fold", "ema double, last_t double, policy binary")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.model.update(([float(x) for x in row["train"]], int(row["n"]), sorted(float(c) for c in row["calib"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.model.exists():
            return  # no baseline: as an inner join, nothing comes out
        flat, n_train, calib = self.model.get()
        train = np.array(flat, np.float64).reshape(n_train, -1)
        ema, policy, last, shown = Ema(self.alpha), self.policy(), None, None
        if self.fold.exists():
            ema.value, last, held = self.fold.get()
            policy, shown = pickle.loads(bytes(held))
        out = []
        pdf = gathered(rows, ["t", "seq"])
        for seq, t, values in zip(pdf["seq"], pdf["t"], pdf["values"]):
            v = np.asarray(values, np.float64)
            n = float(np.sqrt((v * v).sum()))
            near = np.sort(np.clip(1 - train @ (v / n if n else v * 0), 0, 2))[: self.k]
            raw = float(near.sum() / self.k)
            if last is not None and t < last:
                out.append((key[0], seq, t, raw, None, None, "LATE", False))
                continue
            y, last = ema.step(raw), float(t)
            p = 100.0 * bisect_right(calib, y) / len(calib)
            before, shown = shown, policy.step(p, last)
            out.append((key[0], seq, t, raw, y, p, shown, before != shown))
        self.fold.update((ema.value, last, cloudpickle.dumps((policy, shown))))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    def close(self) -> None:
        pass


class Policy(Protocol):
    """Anything that turns percentiles in order of time into states, and can be pickled between micro-batches."""

    def step(self, percentile: float, t: float) -> str: ...


def session_scores(windows: DataFrame, baselines: DataFrame, alpha: float = 0.3, k: int = 2, policy: Callable[[], Policy] | None = None, **bounds) -> DataFrame:
    """What ``monitor.session_states`` gives, with each stream's baseline held in its state.

    ``baselines``(stream_id, train, calib) is a batch table; the first micro-batch deals it to the streams' state, and later ones
    read and shuffle windows alone.  ``policy`` makes a stream's policy, by default an ``AlertPolicy`` with ``bounds``.  Streams without a baseline, or with an empty calibration set, give nothing.
    """
    # one flat array: nested ones that are empty in a batch crash the Arrow reader
    known = baselines.where(F.size("calib") > 0).select("stream_id", F.flatten("train").alias("train"), F.size("train").alias("n"), "calib").groupBy("stream_id")
    return windows.select("stream_id", "seq", "t", "values").groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=SessionScorer(alpha, k, policy or partial(AlertPolicy, **bounds)), outputStructType=OUT, outputMode="Append", timeMode="None", initialState=known
    )


class TapRing(StatefulProcessor):
    """The frames of the last seconds of a stream, and the taps that still wait for theirs."""

    def __init__(self, span_ms: int, keep_ms: int):
        self.span, self.keep = span_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "at long, id long, raw double")
        self.taps = handle.getListState("taps", "id long, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        pdf = gathered(rows, ["at"])
        frames = [(ms(a), int(i), float(r)) for k, a, i, r in zip(pdf["kind"], pdf["at"], pdf["id"], pdf["raw"]) if k == "frame"]
        taps = [(int(i), ms(a)) for k, a, i in zip(pdf["kind"], pdf["tap_ts"], pdf["id"]) if k == "tap"]
        if frames:
            self.ring.appendList(frames)
        now = [t for t in taps if t[1] <= mark]
        later = [t for t in taps if t[1] > mark]
        for t in later:
            self.handle.registerTimer(t[1])
        if later:
            self.taps.appendList(later)
        if frames:
            # the ring empties itself when the stream falls silent
            self.handle.registerTimer(max(f[0] for f in frames) + self.keep)
        if now:
            yield self.answers(key, now)
        if mark > 0:
            self.prune(mark)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        taps = list(self.taps.get()) if self.taps.exists() else []
        now = [t for t in taps if t[1] <= mark]
        if now:
            self.taps.put([tuple(t) for t in taps if t[1] > mark]) if len(now) < len(taps) else self.taps.clear()
            yield self.answers(key, now)
        self.prune(mark)

    def answers(self, key: tuple, taps: list[tuple]) -> pd.DataFrame:
        ring = sorted(self.ring.get()) if self.ring.exists() else []
        at = [f[0] for f in ring]
        out = []
        for tap, t in taps:
            inside = ring[bisect_right(at, t - self.span - 1) : bisect_right(at, t)]
            if inside:
                out.append((tap, key[0], len(inside), inside[0][0] / 1000, inside[-1][0] / 1000, sum(f[2] for f in inside)))
        return pd.DataFrame(out, columns=["tap_id", "stream_id", "frames", "first_s", "last_s", "total"]).astype({"tap_id": "int64", "stream_id": "int64", "frames": "int64"})

    def prune(self, mark: int) -> None:
        if not self.ring.exists():
            return
        waiting = [t[1] - self.span for t in self.taps.get()] if self.taps.exists() else []
        least = min([mark - self.keep, *waiting])
        held = [tuple(f) for f in self.ring.get()]
        kept = [f for f in held if f[0] > least]
        if len(kept) < len(held):
            self.ring.put(kept) if kept else self.ring.clear()

    def close(self) -> None:
        pass


def tap_answers(frames: DataFrame, taps: DataFrame, seconds: int, tap_delay: int = 10, late: str = "0 seconds") -> DataFrame:
    """tap_id, stream_id, frames, first_s, last_s, total of the frames up to ``seconds`` before each tap, as ``events.tap_evidence``.

    frames(stream_id, id, ts, raw) and taps(tap_id, stream_id, tap_ts, at): a tap may arrive (``at``) up to ``tap_delay``
    seconds after its moment and is then answered from the ring at once; an earlier one waits for the watermark to pass
    its moment.  The ring holds ``seconds + tap_delay`` behind the watermark and empties when the stream falls silent.
    Taps without frames give nothing.
    """
    f = frames.select("stream_id", F.lit("frame").alias("kind"), F.col("id").cast("long").alias("id"), F.col("ts").alias("at"), F.col("ts").alias("tap_ts"), F.col("raw").cast("double").alias("raw"))
    t = taps.select("stream_id", F.lit("tap").alias("kind"), F.col("tap_id").cast("long").alias("id"), "at", "tap_ts", F.lit(0.0).alias("raw"))
    both = f.union(t).withWatermark("at", late)
    return both.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=TapRing(seconds * 1000, (seconds + tap_delay) * 1000), outputStructType="tap_id long, stream_id long, frames long, first_s double, last_s double, total double", outputMode="Append", timeMode="EventTime"
    ).withColumns({"first_ts": F.timestamp_millis((F.col("first_s") * 1000).cast("long")), "last_ts": F.timestamp_millis((F.col("last_s") * 1000).cast("long"))}).select("tap_id", "stream_id", "frames", "first_ts", "last_ts", "total")
