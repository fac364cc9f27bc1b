"""Ordered jobs over windows of a stream: smoothing, alerts, streaks, changes, cards, sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.policy import AlertPolicy, Capture, Ema, Throttle, TimedThrottle
from .ordered import ordered_fold


def ema_scores(frames: DataFrame, alpha: float = 0.3) -> DataFrame:
    """stream_id, seq, ema of raw."""
    return ordered_fold(frames, "stream_id", ["seq"], lambda: Ema(alpha), lambda s, r: (s.step(r[0]),), ["raw"], "ema double")


def alert_states(rows: DataFrame, **policy) -> DataFrame:
    """stream_id, seq, t, state after each window of rows(stream_id, seq, t, percentile)."""
    return ordered_fold(rows, "stream_id", ["seq", "t"], lambda: AlertPolicy(**policy), lambda s, r: (s.step(r[0], r[1]),), ["percentile", "t"], "state string")


def hot_streaks(rows: DataFrame, enter: float) -> DataFrame:
    """stream_id, seq, streak: how many hot windows end here, by gaps and islands."""
    w = W.partitionBy("stream_id").orderBy("seq")
    island = F.sum((F.col("percentile") < enter).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    inner = W.partitionBy("stream_id", "island").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("island", island).withColumn("streak", F.sum((F.col("percentile") >= enter).cast("long")).over(inner)).select("stream_id", "seq", "streak")


def state_changes(states: DataFrame) -> DataFrame:
    """Rows whose state differs from the stream's previous one; the first row counts."""
    before = F.lag("state").over(W.partitionBy("stream_id").orderBy("seq"))
    return states.withColumn("previous", before).where(~F.col("previous").eqNullSafe(F.col("state")))


def throttled_cards(cards: DataFrame, interval: float = 2.0) -> DataFrame:
    """stream_id, seq, t, line of the cards that are shown."""
    return ordered_fold(cards, "stream_id", ["seq", "t"], lambda: Throttle(interval), lambda s, r: (r[0],) if s.step((r[0],), r[1]) else None, ["line", "t"], "line string")


def timed_cards(cards: DataFrame, interval: float = 2.0) -> DataFrame:
    """stream_id, t, line of the cards that are shown, waiting ones at the time their interval ends.

    The next card's time, or the end of the stream, tells whether a waiting card is still flushed before it.
    """
    rows = cards.withColumn("next_t", F.lead("t").over(W.partitionBy("stream_id").orderBy("seq")))

    def step(s: TimedThrottle, row: tuple) -> tuple:
        line, t, next_t = row
        shown = [{"t": t, "line": line}] if s.offer(line, t) else []
        due = s.due()
        if due is not None and not (next_t is not None and next_t <= due):
            shown.append({"t": due, "line": s.flush()})
        return (shown,)

    out = ordered_fold(rows, "stream_id", ["seq"], lambda: TimedThrottle(interval), step, ["line", "t", "next_t"], "shown array<struct<t:double,line:string>>")
    return out.select("stream_id", F.explode("shown").alias("s")).select("stream_id", "s.t", "s.line")


def capture_chunks(chunks: DataFrame, **bounds) -> DataFrame:
    """capture_id, seq, accepted for chunks(capture_id, seq, n_bytes)."""
    return ordered_fold(chunks, "capture_id", ["seq"], lambda: Capture(**bounds), lambda s, r: (s.step(int(r[0])),), ["n_bytes"], "accepted boolean")


def capture_totals(chunks: DataFrame, bytes_per_second: int = 32_000, **bounds) -> DataFrame:
    """capture_id, n_bytes, seconds, n_accepted, n_refused."""
    judged = capture_chunks(chunks, bytes_per_second=bytes_per_second, **bounds).join(chunks, ["capture_id", "seq"])
    size = F.sum(F.when(F.col("accepted"), F.col("n_bytes")).otherwise(0)).cast("long")
    return judged.groupBy("capture_id").agg(size.alias("n_bytes"), (size / bytes_per_second).alias("seconds"), F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_refused"))


def sliding_windows(frames: DataFrame, size: int = 3, value: str = "raw") -> DataFrame:
    """stream_id, window_no, t_end, values: full windows of consecutive frames, one frame apart.

    Counted in frames, so gaps in wall time open none in t; samples are never exploded.
    """
    w = W.partitionBy("stream_id").orderBy("seq")
    values = F.collect_list(value).over(w.rowsBetween(-(size - 1), 0))
    return frames.withColumn("values", values).withColumn("n", F.row_number().over(w)).where(F.col("n") >= size).select("stream_id", (F.col("n") - size).cast("long").alias("window_no"), F.col("n").cast("double").alias("t_end"), "values")


def late_rows(rows: DataFrame) -> DataFrame:
    """Rows, in arrival order, whose t is below one already seen, or whose percentile is outside 0..100."""
    seen = F.max("t").over(W.partitionBy("stream_id").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1))
    reason = F.when(~F.col("percentile").between(0, 100), "range").when(F.col("t") < seen, "late")
    return rows.withColumn("reason", reason).where("reason is not null")


def latest(rows: DataFrame, value: str = "raw") -> DataFrame:
    """Each stream's value at its largest t."""
    return rows.groupBy("stream_id").agg(F.max("t").alias("t"), F.max_by(value, F.struct("t", "seq")).alias(value))
