"""A machine's healthy baseline: calibration holdout, percentiles, mean spectrum, augmented copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .scan import running_sums

HOLD_EVERY, LEAST_WINDOWS = 5, 10


def calib_holdout(windows: DataFrame, key: str = "stream_id") -> DataFrame:
    """Adds part (calib for every fifth window, else train) and t, the window's index; keys with under ten windows are left out."""
    w = W.partitionBy(key).orderBy("seq")
    i = F.row_number().over(w) - 1
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    return windows.withColumns({"i": i.cast("long"), "n": n}).where(F.col("n") >= LEAST_WINDOWS).withColumn("part", F.when(F.col("i") % HOLD_EVERY == HOLD_EVERY - 1, "calib").otherwise("train")).drop("n")


def calibration(held: DataFrame, key: str = "stream_id", score: str = "raw") -> DataFrame:
    """key, calib: the sorted calibration scores; a few numbers per 30 seconds of baseline."""
    return held.where("part = 'calib'").groupBy(key).agg(F.array_sort(F.collect_list(score)).alias("calib"))


def percentile_of(score: Column, calib: Column) -> Column:
    """100 x the share of calibration scores at or below; an empty set is an error."""
    n = F.size(calib)
    return F.when(n == 0, F.raise_error(F.lit("empty calibration set"))).otherwise(100.0 * F.size(F.filter(calib, lambda c: c <= score)) / n)


def calib_percentile(rows: DataFrame, calib: DataFrame, key: str = "stream_id", score: str = "raw") -> DataFrame:
    return rows.join(calib, key).withColumn("percentile", percentile_of(F.col(score), F.col("calib"))).drop("calib")


def percentile_by_rank(rows: DataFrame, calib_rows: DataFrame, key: str, score: str) -> DataFrame:
    """The same percentile for large calibration sets: both sides dealt by range of score, and a running count over slices."""
    tie = F.xxhash64(*[c for c in rows.columns if c not in (key, score)])
    both = rows.withColumns({"_c": F.lit(0), "_tie": tie}).unionByName(calib_rows.select(key, score).withColumns({"_c": F.lit(1), "_tie": F.lit(0).cast("long")}), allowMissingColumns=True)
    # calibration scores stand before equal ones
    counted = running_sums(both.withColumn("_after", 1 - F.col("_c")), [key], [score, "_after", "_tie"], ["_c"])
    return counted.where("_c = 0").withColumn("percentile", 100.0 * F.col("below__c") / F.col("all__c")).drop("_c", "_tie", "_after", "below__c", "all__c")


def mean_vector(rows: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """keys, mean: element-wise mean of vectors, as (position, mean) sums that combine before the shuffle."""
    place = rows.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("m"))
    return place.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select(*keys, F.transform("s", lambda x: x["m"]).alias("mean"))


def augmented(windows: DataFrame, copies: list, vector: str = "v") -> DataFrame:
    """Train windows with transformed copies of themselves; calibration windows stay as they are.

    ``copies`` are functions of a column; copies keep their source's time.
    """
    out = windows.withColumn("copy", F.lit(0))
    for k, change in enumerate(copies, 1):
        out = out.unionByName(windows.where("part = 'train'").withColumn(vector, change(F.col(vector))).withColumn("copy", F.lit(k)))
    return out
