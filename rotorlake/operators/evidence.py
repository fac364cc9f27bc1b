"""What speaks for an alert: band changes, spectral peaks, nearest healthy windows, a line of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.scalars import band_phrase, peak_label, summary
from .neighbours import Neighbours


def top_band_deltas(spectra: DataFrame, baseline: DataFrame, keys: list[str], edges: list[float], top: int = 3) -> DataFrame:
    """vec_id, rank, band, lo_hz, hi_hz, delta_db of the bands that moved most, sign kept; ties by band."""
    gap = F.zip_with("v", "mean", lambda a, b: F.round(a - b, 6))
    rows = spectra.join(baseline, keys).select("vec_id", F.posexplode(gap).alias("band", "delta_db"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc(F.abs("delta_db")), "band"))).where(F.col("rank") <= top)
    table = F.array(*map(F.lit, edges))
    return ranked.select("vec_id", F.col("rank").cast("long").alias("rank"), F.col("band").cast("long").alias("band"), table[F.col("band")].alias("lo_hz"), table[F.col("band") + 2].alias("hi_hz"), "delta_db")


def rank_peaks(peaks: DataFrame, top: int = 3, lo: float = 5.0, hi: float = 300.0, share: float = 0.1) -> DataFrame:
    """The most prominent peaks of peaks(vec_id, freq_hz, prominence) in a range, at least a share of the largest there."""
    inside = peaks.where(F.col("freq_hz").between(lo, hi))
    largest = F.max("prominence").over(W.partitionBy("vec_id"))
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("prominence"), "freq_hz"))
    return inside.withColumn("_most", largest).where(F.col("prominence") >= share * F.col("_most")).withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).drop("_most")


def local_peaks(vectors: DataFrame, step_hz: float) -> DataFrame:
    """vec_id, freq_hz, prominence of the inner points above both neighbours (prominence: above the higher one)."""
    at = vectors.select("vec_id", F.posexplode("v").alias("i", "x"), "v")
    left, right = F.get("v", F.col("i") - 1), F.get("v", F.col("i") + 1)
    return at.where((F.col("x") > left) & (F.col("x") > right)).select("vec_id", (F.col("i") * F.lit(step_hz)).alias("freq_hz"), F.round(F.col("x") - F.greatest(left, right), 6).alias("prominence"))


def nearest_baseline(windows: DataFrame, train: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """vec_id, times of the k nearest healthy windows of the same keys, nearest first; ties by time."""
    near = Neighbours(train, keys, "t").search(windows, "vec_id", k)
    return near.select("vec_id", F.transform("near", lambda x: x["t_id"]).alias("times"))


def text(bands: DataFrame, peaks: DataFrame) -> DataFrame:
    """vec_id, hud from each window's first band and first peak; a window may lack either."""
    first_band = bands.where("rank = 1").select("vec_id", band_phrase(F.col("lo_hz"), F.col("hi_hz"), F.col("delta_db")).alias("phrase"))
    first_peak = peaks.where("rank = 1").select("vec_id", "freq_hz", "label")
    rows = first_band.join(first_peak, "vec_id", "full")
    return rows.select("vec_id", summary(F.col("label"), F.col("freq_hz"), F.coalesce("phrase", F.lit("anomaly vs baseline"))).alias("hud"))


def labelled_peaks(peaks: DataFrame, rpm) -> DataFrame:
    return peaks.withColumn("label", peak_label(F.col("freq_hz"), rpm))


def gated(states: DataFrame) -> DataFrame:
    """Only windows in SUSPECT or ALERT go on to evidence, so its cost follows alerts and not time."""
    return states.where(F.col("state").isin("SUSPECT", "ALERT"))
