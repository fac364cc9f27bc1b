"""A monitoring session: windows of a healthy machine become its baseline, later windows are scored against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bound, cosine_distance, unit
from .baseline import calib_holdout


def knn_mean(v: Column, train: Column, k: int = 2) -> Column:
    """Mean of the k smallest cosine distances of a vector to an array of unit vectors."""
    near = F.slice(F.array_sort(bound(unit(v), lambda u: F.transform(train, lambda t: cosine_distance(u, t)))), 1, k)
    return F.aggregate(near, F.lit(0.0), lambda a, d: a + d) / k


def fit(windows: DataFrame, vector: str = "values", k: int = 2) -> DataFrame:
    """stream_id, train (unit vectors), calib (sorted scores of the held-out fifth), n_windows of each stream.

    windows(stream_id, seq, vector) are one baseline capture each, some thirty windows; streams of under ten windows,
    or with fewer than k train windows, have no baseline.
    """
    held = calib_holdout(windows)
    rows = F.struct("i", unit(F.col(vector)).alias("u"))
    g = held.groupBy("stream_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("part") == "train", rows))).alias("t"),
        F.collect_list(F.when(F.col("part") == "calib", F.col(vector))).alias("c"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    g = g.withColumn("train", F.transform("t", lambda x: x["u"])).where(F.size("train") >= k)
    return g.select("stream_id", "train", F.array_sort(F.transform("c", lambda v: knn_mean(v, F.col("train"), k))).alias("calib"), "n_windows")


def raw_scores(windows: DataFrame, baselines: DataFrame, vector: str = "values", k: int = 2) -> DataFrame:
    """windows with raw, their score against their stream's baseline; batch or stream joined with a static table."""
    known = baselines.select(F.col("stream_id").alias("b_stream"), F.col("train").alias("b_train"))
    return windows.join(known, F.col("stream_id") == F.col("b_stream")).withColumn("raw", knn_mean(F.col(vector), F.col("b_train"), k)).drop("b_stream", "b_train")
