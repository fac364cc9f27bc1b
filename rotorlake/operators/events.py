"""Frames, taps, sessions and spans: interval joins and interval merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

RATES = (8000, 16000, 22050, 32000, 44100, 48000)


def tap_evidence(taps: DataFrame, frames: DataFrame, seconds: int) -> DataFrame:
    """tap_id, frames, first_ts, last_ts, total of the frames in the interval up to each tap, both ends included.

    Time is cut into buckets as long as the interval; a tap meets only its own bucket and the one before, so the
    join is an equi-join on stream and bucket, and a busy stream spreads over its buckets.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    t = taps.select(F.col("event_id").alias("tap_id"), "stream_id", F.col("ts").alias("tap_ts"), bucket("ts").alias("b")).withColumn("b", F.explode(F.array(F.col("b"), F.col("b") - 1)))
    f = frames.select("stream_id", "ts", "raw", bucket("ts").alias("b"))
    span = F.expr(f"tap_ts - interval {seconds} seconds")
    return (
        t.join(f, ["stream_id", "b"])
        .where((F.col("ts") <= F.col("tap_ts")) & (F.col("ts") >= span))
        .groupBy("tap_id", "stream_id")
        .agg(F.count(F.lit(1)).alias("frames"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum("raw"), 6).alias("total"))
    )


def last_frames(frames: DataFrame, n: int = 10) -> DataFrame:
    """Adds ring: the last n values of the stream up to each frame."""
    return frames.withColumn("ring", F.collect_list("raw").over(W.partitionBy("stream_id").orderBy("seq").rowsBetween(-(n - 1), 0)))


def idle_sessions(frames: DataFrame, gap_s: int) -> DataFrame:
    """stream_id, started, ended (last frame), n; a silence of more than the gap ends a session, exactly the gap does not."""
    before = F.lag("ts").over(W.partitionBy("stream_id").orderBy("ts", "event_id"))
    new = F.col("before").isNull() | (F.col("ts") > F.expr(f"before + interval {gap_s} seconds"))
    session = F.sum(new.cast("int")).over(W.partitionBy("stream_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    return frames.withColumn("before", before).withColumn("session", session).groupBy("stream_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n")).drop("session")


def coalesce_spans(spans: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """keys, start, end, n of the runs that spans form when gaps of at most ``gap`` are bridged."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.col("reach").isNull() | (F.col("start") - F.col("reach") > gap)
    run = F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return spans.withColumn("reach", reach).withColumn("run", run).groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("run")


def member_spans(members: DataFrame, keys: list[str], size_of_archive: str) -> DataFrame:
    """Adds start and end of archive members: each ends where the next one's header begins, the last at the archive's end."""
    end = F.lead("local_header_offset").over(W.partitionBy(*keys).orderBy("local_header_offset"))
    return members.withColumns({"start": F.col("local_header_offset"), "end": F.coalesce(end, F.col(size_of_archive))})


def exact_frames(chunks: DataFrame, frame_bytes: int = 32_000) -> DataFrame:
    """stream_id, n_bytes, n_frames, padded: whole frames however the stream was cut; a tail of half a frame or more is padded."""
    total = chunks.groupBy("stream_id").agg(F.sum("n_bytes").alias("n_bytes"))
    even = (F.floor(F.col("n_bytes") / 2) * 2).cast("long")
    padded = (even % frame_bytes >= frame_bytes // 2).cast("long")
    return total.select("stream_id", "n_bytes", (F.floor(even / frame_bytes) + padded).cast("long").alias("n_frames"), padded.alias("padded"))


def frame_pieces(chunks: DataFrame, frame_bytes: int = 32_000) -> DataFrame:
    """stream_id, frame_no, seq, from_byte, to_byte (in the chunk): which bytes of which chunks make up each frame.

    A last odd byte is left out; a tail of half a frame or more makes a frame, a shorter one none.  Chunk places
    are running sums, and a chunk is dealt to the frames it touches, so no stream is put together in one place.
    """
    at = F.coalesce(F.sum("n_bytes").over(W.partitionBy("stream_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = chunks.groupBy("stream_id").agg(F.expr("sum(n_bytes) div 2 * 2").alias("even"))
    rows = chunks.withColumn("start", at.cast("long")).join(total, "stream_id").withColumn("stop", F.least(F.col("start") + F.col("n_bytes"), "even"))
    rows = rows.where("stop > start").withColumn("frame_no", F.explode(F.expr(f"sequence(start div {frame_bytes}, (stop - 1) div {frame_bytes})")))
    whole = f"(frame_no + 1) * {frame_bytes} <= even or even - frame_no * {frame_bytes} >= {frame_bytes // 2}"
    return rows.where(whole).select(
        "stream_id", "frame_no", "seq",
        F.expr(f"greatest(start, frame_no * {frame_bytes}) - start").alias("from_byte"),
        F.expr(f"least(stop, (frame_no + 1) * {frame_bytes}) - start").alias("to_byte"),
    )


def cut_frames(chunks: DataFrame, frame_bytes: int = 32_000) -> DataFrame:
    """stream_id, frame_no, data: chunks(stream_id, seq, data) cut into frames of ``frame_bytes``, the last one padded with zeros."""
    pieces = frame_pieces(chunks.select("stream_id", "seq", F.octet_length("data").cast("long").alias("n_bytes")), frame_bytes)
    cut = pieces.join(chunks.select("stream_id", "seq", "data"), ["stream_id", "seq"]).withColumn("piece", F.expr("substring(data, cast(from_byte as int) + 1, cast(to_byte - from_byte as int))"))
    frame = cut.groupBy("stream_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("p"))
    data = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["piece"]))
    return frame.select("stream_id", "frame_no", data.alias("data")).withColumn("data", F.expr(f"rpad(data, {frame_bytes}, x'00')"))


def chunks_of_clips(clips: DataFrame, chunk: int) -> DataFrame:
    """vec_id, chunk_no, v: the fixed chunks of each clip's samples, the last partial one included."""
    n = F.ceil(F.size("v") / chunk).cast("int")
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("v", i * chunk + 1, chunk)))
    return clips.select("vec_id", F.posexplode(pieces).alias("chunk_no", "v"))


def fresh_frames(frames: DataFrame, limit_s: float = 2.5) -> DataFrame:
    """Frames processed no later than the limit after they were made."""
    return frames.where(F.col("delay_s") <= limit_s)


def rate_estimate(chunks: DataFrame, declared: int, channels: int = 1, rates=RATES, least_s: float = 3.0, tolerance: float = 0.2) -> DataFrame:
    """stream_id, estimate (samples a second from the bytes after the first chunk; null under 3 s), rate to use."""
    g = chunks.groupBy("stream_id").agg(F.min_by("n_bytes", F.struct("at", "seq")).alias("first"), F.sum("n_bytes").alias("total"), (F.max("at") - F.min("at")).alias("span"))
    estimate = F.when(F.col("span") >= least_s, (F.col("total") - F.col("first")) / F.col("span") / 2 / channels)
    near = F.array_min(F.transform(F.array(*map(F.lit, rates)), lambda r: F.struct(F.abs(r - F.col("estimate")).alias("d"), r.alias("r"))))["r"]
    off = F.abs(F.col("estimate") - declared) / declared > tolerance
    return g.withColumn("estimate", F.round(estimate, 6)).select("stream_id", "estimate", F.when(off, near).otherwise(F.lit(declared)).cast("long").alias("rate"))


def unique_stems(rows: DataFrame) -> DataFrame:
    """doc_id, stem: tag and time stamp; the second and later of a name get _1, _2, ... in order of arrival."""
    base = F.concat_ws("_", "tag", F.date_format("created_at", "yyyyMMdd_HHmmss"))
    n = F.row_number().over(W.partitionBy("base").orderBy("created_at", "doc_id")) - 1
    return rows.withColumn("base", base).withColumn("n", n).select("doc_id", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string"))).alias("stem"))


def chunk_counts(clips: DataFrame, chunk: int) -> DataFrame:
    """vec_id, chunk_no, n of the fixed chunks of each clip's samples, the last partial one included."""
    n = F.ceil(F.size("v") / chunk).cast("int")
    return clips.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.size(F.slice("v", i * chunk + 1, chunk)))).alias("chunk_no", "n")).select("vec_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("n").cast("long").alias("n"))
