"""Guards that cost no scan of their own: counts observed while rows are written, bad rows set aside with their fault.

    good = checked(rows, path, {"no_vector": F.col("v").isNull()}, some={"train": F.col("part") == "train"})

Rows are written once, good and bad side by side.  The counts come with that write; a fault that is not among ``allowed``, or
a side with no good row, raises ``GuardError`` with all counts.  What was set aside stays for ``set_aside``.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEYS = ["machine", "machine_id"]


class GuardError(ValueError):
    """Counts of what was wrong: rows by fault, and 0 for each side that is empty."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(", ".join(f"{k}: {v}" for k, v in counts.items()))
        self.counts = counts


def checked(rows: DataFrame, path: str, faults: dict[str, Column], some: dict[str, Column] | None = None, allowed: Collection[str] = ()) -> DataFrame:
    """The rows without a fault, read back from ``path``; a row has the first fault whose condition is true."""
    fault = F.coalesce(*[F.when(c, F.lit(name)) for name, c in faults.items()], F.lit("")) if faults else F.lit("")
    told = rows.withColumn("fault", fault)
    counts = [F.count_if(F.col("fault") == name).alias(f"fault_{name}") for name in faults]
    counts += [F.count_if((F.col("fault") == "") & c).alias(f"some_{name}") for name, c in (some or {}).items()]
    seen = Observation()
    if counts:
        told = told.observe(seen, *counts)
    told.withColumn("good", F.col("fault") == "").write.mode("overwrite").partitionBy("good").parquet(path)
    got = seen.get if counts else {}
    wrong = {name: got[f"fault_{name}"] for name in faults if got[f"fault_{name}"] and name not in allowed}
    wrong |= {name: 0 for name in some or {} if not got[f"some_{name}"]}
    if wrong:
        raise GuardError(wrong)
    return part_of(rows.sparkSession, path, told, True).drop("fault")


def part_of(spark: SparkSession, path: str, like: DataFrame, good: bool) -> DataFrame:
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in like.schema)}, good boolean").parquet(path).where(F.col("good") == good).drop("good")


def set_aside(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``checked`` left out, each with its fault."""
    return spark.read.parquet(path).where("not good").drop("good")


# guards of jobs


def with_features(clips: DataFrame, features: DataFrame, width: int, path: str, allowed: Collection[str] = ()) -> DataFrame:
    """clips(path, ...) with v of features(path, v): a clip without one, with another width or a non-finite entry is a fault."""
    known = features.select(F.col("path").alias("_path"), F.col("v").cast("array<double>").alias("v"))
    rows = clips.drop("v").join(known, F.col("path") == F.col("_path"), "left").drop("_path")
    infinite = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return checked(rows, path, {"no_feature": F.col("v").isNull(), "width": F.size("v") != width, "not_finite": infinite}, allowed=allowed)


def sides(rows: DataFrame, path: str, part: str = "part", names: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """Rows dealt to sides none of which may be empty."""
    return checked(rows, path, {"no_part": F.col(part).isNull()}, {n: F.col(part) == n for n in names})


def split_with_train(split: DataFrame, path: str) -> DataFrame:
    """Rows of ``splits.anomaly_split``; an id without more normals than abnormals is a fault of its rows.

    The counts of an id are an aggregation, joined back by id.
    """
    n = split.groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS]).agg((F.count_if(F.col("label") != "abnormal") <= F.count_if(F.col("label") == "abnormal")).alias("_few"))
    rows = split.join(n, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS])
    told = rows.withColumn("_faulty", F.col("_few")).drop("_few", *[f"_{k}" for k in KEYS])
    return checked(told, path, {"few_normals": F.col("_faulty")}).drop("_faulty")


def whole_bands(gains: DataFrame, n_bands: int, path: str, allowed: Collection[str] = ()) -> DataFrame:
    """Rows of ``degraded.band_gains`` of recordings none of whose bands is empty."""
    held = gains.groupBy(F.col("vec_id").alias("_vec_id")).agg(F.count(F.lit(1)).alias("_bands"))
    rows = gains.join(held, F.col("vec_id") == F.col("_vec_id")).drop("_vec_id")
    return checked(rows, path, {"empty_band": F.col("_bands") < n_bands}, allowed=allowed).drop("_bands")
