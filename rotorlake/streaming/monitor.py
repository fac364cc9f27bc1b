"""Live monitoring as Structured Streaming: windows, smoothing, percentile, alert state, taps.

One shuffle on stream_id stands before the stateful step; what a stream needs between micro-batches is a handful
of numbers.  Rows of a micro-batch are sorted by time before they are folded; rows older than the last one
seen go to the output with the state ``LATE`` and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.policy import LISTENING, AlertPolicy, Ema, TimedThrottle
from ..operators import session

OUT = "stream_id long, seq long, t double, raw double, ema double, percentile double, state string, changed boolean"
STATE = "ema double, state string, streak int, cooldown_until double, last_t double"


def scored(frames: DataFrame, calib: DataFrame, alpha: float = 0.3, **policy) -> DataFrame:
    """frames(stream_id, seq, t, raw) with ema, the ema's percentile among calib(stream_id, calib), and alert state.

    A stream-static join brings the calibration scores (a few per stream); streams without any are left out.
    """
    rows = frames.select("stream_id", "seq", "t", "raw").join(calib.select("stream_id", "calib"), "stream_id")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, alert = Ema(alpha), AlertPolicy(**policy)
        if state.exists:
            ema.value, alert.state, alert.streak, alert.cooldown_until, alert.last_t = state.get
        pdf = pd.concat(list(batches)).sort_values(["t", "seq"])
        out = []
        for seq, t, raw, calib in zip(pdf["seq"], pdf["t"], pdf["raw"], pdf["calib"]):
            if alert.last_t is not None and t < alert.last_t:
                out.append((key[0], seq, t, raw, None, None, "LATE", False))
                continue
            y = ema.step(raw)
            p = 100.0 * sum(c <= y for c in calib) / len(calib)
            before = alert.state if alert.last_t is not None else None
            out.append((key[0], seq, t, raw, y, p, alert.step(p, t), before != alert.state))
        state.update((ema.value, alert.state or LISTENING, alert.streak, alert.cooldown_until, alert.last_t))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    return rows.groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


CARDS = "stream_id long, t double, line string"
CARD_STATE = "shown string, shown_at double, waiting string"


def timed_cards(cards: DataFrame, interval: float = 2.0, late: str = "0 seconds") -> DataFrame:
    """stream_id, t, line of the cards shown from a stream of cards(stream_id, ts, line); t in seconds.

    At most one card per interval; the latest waiting one is shown when its interval ends, by an event-time timer that
    the watermark sets off, or by the next card if that comes first.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = TimedThrottle(interval, *(state.get if state.exists else ()))
        out = []
        if not state.hasTimedOut:
            pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for ts, line in zip(pdf["ts"], pdf["line"]):
                t = ts.timestamp()
                if s.waiting is not None and s.due() < t:
                    out.append((key[0], s.due(), s.waiting))
                    s.flush()
                if s.offer(line, t):
                    out.append((key[0], t, line))
        mark = state.getCurrentWatermarkMs()
        if s.waiting is not None and (state.hasTimedOut or s.due() * 1000 <= mark):
            out.append((key[0], s.due(), s.waiting))
            s.flush()
        state.update((s.shown, s.shown_at, s.waiting))
        if s.waiting is not None:
            state.setTimeoutTimestamp(int(s.due() * 1000))
        yield pd.DataFrame(out, columns=["stream_id", "t", "line"])

    return cards.withWatermark("ts", late).groupBy("stream_id").applyInPandasWithState(step, CARDS, CARD_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def session_states(windows: DataFrame, baselines: DataFrame, alpha: float = 0.3, **policy) -> DataFrame:
    """Windows (stream_id, seq, t, values) of a stream scored against saved baselines, as ``scored`` gives them."""
    return scored(session.raw_scores(windows, baselines), baselines, alpha, **policy)


def full_windows(frames: DataFrame, size_s: int = 3, late: str = "10 seconds") -> DataFrame:
    """stream_id, t_end, values of windows of ``size_s`` one-second frames that hold a frame for every second."""
    w = F.window("ts", f"{size_s} seconds", "1 second")
    g = frames.withWatermark("ts", late).groupBy("stream_id", w).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ts", "raw"))).alias("x"))
    return g.where(F.col("n") == size_s).select("stream_id", F.col("window.end").alias("t_end"), F.col("x.raw").alias("values"))


def taps_with_frames(taps: DataFrame, frames: DataFrame, seconds: int, late: str = "10 seconds") -> DataFrame:
    """tap_id, frame_id, ts of the frames up to ``seconds`` before each tap: a stream-stream interval join.

    Watermarks on both sides bound how long frames and taps are kept.
    """
    t = taps.withWatermark("tap_ts", late).select("tap_id", F.col("stream_id").alias("tap_stream"), "tap_ts")
    f = frames.withWatermark("ts", late)
    inside = F.expr(f"tap_stream = stream_id AND ts <= tap_ts AND ts >= tap_ts - INTERVAL {seconds} SECONDS")
    return f.join(t, inside).select("tap_id", "stream_id", F.col("event_id").alias("frame_id"), "ts")


def sessions(frames: DataFrame, gap: str, late: str) -> DataFrame:
    """stream_id, started, ended, n; a session closes when the gap has passed."""
    g = frames.withWatermark("ts", late).groupBy("stream_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return g.select("stream_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")
