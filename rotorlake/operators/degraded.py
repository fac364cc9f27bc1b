"""Clean against degraded capture: substitution, coverage, noise, playlists, segments, conditions, bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.scalars import bound, peak, power
from . import metrics
from .tables import written

KEYS = ["machine", "machine_id"]


def substitute(split: DataFrame, degraded: DataFrame) -> DataFrame:
    """Test rows take the degraded vector where there is one; train rows never do.  Adds replaced."""
    d = degraded.select(F.col("path").alias("d_path"), F.col("v").alias("d_v"))
    rows = split.join(d, (F.col("path") == F.col("d_path")) & (F.col("split") != "train"), "left")
    return rows.withColumn("replaced", F.col("d_v").isNotNull()).withColumn("v", F.coalesce("d_v", "v")).drop("d_path", "d_v")


def coverage(substituted: DataFrame) -> DataFrame:
    """n_replaced, n_test; no replaced clip at all is an error."""
    n = F.count_if(F.col("replaced"))
    return substituted.where("split <> 'train'").agg(F.when(n == 0, F.raise_error(F.lit("no test clip was replaced"))).otherwise(n).cast("long").alias("n_replaced"), F.count(F.lit(1)).alias("n_test"))


def missing_coverage(split: DataFrame, degraded: DataFrame) -> DataFrame:
    """keys, n, paths: test clips that have no degraded counterpart."""
    gone = split.where("split <> 'train'").join(degraded.select("path"), "path", "left_anti")
    return gone.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))


def missing_features(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose features are still to be computed."""
    return wanted.join(present, keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "condition") -> DataFrame:
    """Old rows of other keys, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def rerun(split: DataFrame, captures: dict[str, DataFrame], scorers: dict[str, Callable[[DataFrame], DataFrame]], ids: DataFrame | None = None) -> DataFrame:
    """condition, machine, scorer, auc, pauc, n_replaced, n_test: the clean test clips and those of each capture(path, v).

    Each scorer learns from the clean train clips, whatever the condition.  With ``ids`` only theirs are scored; the split is made before,
    so the same clips are drawn.  A capture that replaces no test clip is an error.
    """
    own = split if ids is None else split.join(ids, KEYS, "left_semi")
    own = written(own.select("vec_id", *KEYS, "path", "split", "v"), "split")
    names = ["clean", *captures]
    # the test clips of all conditions are scored together: their ids tell the condition
    numbered = lambda rows, k: rows.select((F.col("vec_id") * len(names) + k).alias("vec_id"), *KEYS, "split", "v", "replaced")
    rows = numbered(own.withColumn("replaced", F.lit(False)), 0)
    for k, capture in enumerate(captures.values(), 1):
        rows = rows.unionByName(numbered(substitute(own.where("split <> 'train'"), capture), k))
    rows = written(rows, "conditions")
    condition = F.array(*map(F.lit, names))[F.pmod("vec_id", F.lit(len(names))).cast("int")].alias("condition")
    n = F.count_if("replaced")
    known = rows.where("split <> 'train'").groupBy(condition).agg(n.cast("long").alias("n_replaced"), F.count(F.lit(1)).alias("n_test"))
    none = F.raise_error(F.concat(F.lit("no test clip was replaced: "), "condition"))
    known = known.withColumn("n_replaced", F.when((F.col("condition") != "clean") & (F.col("n_replaced") == 0), none).otherwise(F.col("n_replaced")))
    out = None
    for name, score in scorers.items():
        per_id = metrics.metrics(score(rows.drop("replaced")).select("*", condition), ["condition", *KEYS])
        one = per_id.groupBy("condition", "machine").agg(F.avg("auc").alias("auc"), F.avg("pauc").alias("pauc")).withColumn("scorer", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return written(out.join(known, "condition").select("condition", "machine", "scorer", "auc", "pauc", "n_replaced", "n_test"), "rerun")


def noisy(clips: DataFrame, noise: DataFrame, snr_db: float) -> DataFrame:
    """path, v of clips mixed with the noise(noise_no, v) that ``noise_assignment`` gives them, at one level; clips without power are left out."""
    given = noise_assignment(clips, [snr_db], noise.count()).withColumnRenamed("path", "n_path")
    table = noise.select("noise_no", F.col("v").alias("noise"))
    rows = clips.join(given, F.col("path") == F.col("n_path")).join(table, "noise_no")
    return rows.select("path", mix_at_snr(F.col("v"), F.col("noise"), F.col("snr_db")).alias("v")).where("v is not null")


def condition_report(results: DataFrame, columns: list[str], coverage: DataFrame | None = None) -> DataFrame:
    """One row per condition with an AUC column per machine and scorer; clean first, then by name."""
    wide = results.withColumn("c", F.concat_ws("_", "machine", "scorer")).groupBy("condition").pivot("c", columns).agg(F.avg("auc"))
    wide = wide.join(coverage, "condition") if coverage is not None else wide
    return wide.orderBy(F.col("condition") != "clean", "condition")


def condition_verdict(results: DataFrame, keep: float = 0.8) -> DataFrame:
    """condition, keys, auc, retained (margin above chance against clean), verdict."""
    by = ["machine", "scorer"]
    clean = results.where("condition = 'clean'").select(*by, F.col("auc").alias("clean_auc"))
    rows = results.where("condition <> 'clean'").join(clean, by)
    retained = (F.col("auc") - 0.5) / F.nullif(F.col("clean_auc") - 0.5, F.lit(0.0))
    return rows.select("condition", *by, "auc", retained.alias("retained")).withColumn("verdict", F.when(F.col("retained") >= keep, "PASS").otherwise("FAIL"))


def noise_assignment(clips: DataFrame, snrs: list[float], n_noise: int) -> DataFrame:
    """path, snr_db, noise_no: one noise clip for each clip and level, by hash and so the same in every run."""
    levels = F.explode(F.array(*[F.lit(float(x)) for x in snrs]))
    rows = clips.select("path", levels.alias("snr_db"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "path", F.col("snr_db").cast("int").cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.withColumn("noise_no", h % n_noise)


def mix_at_snr(clean: Column, noise: Column, snr_db: Column) -> Column:
    """Clean plus noise scaled to the level; the whole is brought to 0.99 if its peak passes 1; no power is null."""
    level = lambda p: F.sqrt(p["pc"] / (F.pow(F.lit(10.0), snr_db / 10) * p["pn"]))
    limited = lambda m: bound(peak(m), lambda top: F.when(top > 1, F.transform(m, lambda x: x * 0.99 / top)).otherwise(m))
    mixed = lambda scale: bound(F.zip_with(clean, noise, lambda a, b: a + scale * b), limited)
    powers = F.struct(power(clean).alias("pc"), power(noise).alias("pn"))
    return bound(powers, lambda p: F.when((p["pc"] > 0) & (p["pn"] > 0), bound(level(p), mixed)))


def playlist_offsets(clips: DataFrame, chirp: int, silence: int, keys: list[str]) -> DataFrame:
    """Adds start_sample: after chirp and silence, and all clips before with a silence behind each."""
    before = F.sum(F.col("n_samples") + silence).over(W.partitionBy(*keys).orderBy("idx").rowsBetween(W.unboundedPreceding, -1))
    return clips.withColumn("start_sample", (F.lit(chirp + silence) + F.coalesce(before, F.lit(0))).cast("long"))


def segment_plan(entries: DataFrame, blocks: DataFrame, lag: int, slack: int, grid: int) -> DataFrame:
    """Where each clip of a playlist lies in the blocks of its recording: range join on a grid.

    entries(rec, idx, start_sample, n_samples); blocks(rec, block_no, b_start, b_end).  Returns rec, idx, block_no,
    nominal, from_sample, to_sample (within the block).
    """
    e = entries.withColumn("nominal", F.col("start_sample") + lag).withColumns({"lo": F.col("nominal") - slack, "hi": F.col("nominal") + F.col("n_samples") + slack})
    cell = lambda c: F.floor(F.col(c) / grid).cast("long")
    e = e.withColumn("cell", F.explode(F.sequence(cell("lo"), F.floor((F.col("hi") - 1) / grid).cast("long"))))
    b = blocks.withColumn("cell", F.explode(F.sequence(cell("b_start"), F.floor((F.col("b_end") - 1) / grid).cast("long"))))
    hit = e.join(b, ["rec", "cell"]).where("lo < b_end and hi > b_start")
    one = hit.where(F.col("cell") == F.greatest(cell("lo"), cell("b_start")))
    return one.select("rec", "idx", "block_no", "nominal", (F.greatest("lo", "b_start") - F.col("b_start")).alias("from_sample"), (F.least("hi", "b_end") - F.col("b_start")).alias("to_sample"))


def band_gains(bins: DataFrame, n_bands: int, f0: float, f1: float) -> DataFrame:
    """vec_id, band, n, gain_db (less the median band), flatness_db over geometric bands, the last one closed.

    bins(vec_id, freq, gain_db); the few bands are broadcast for the range join.
    """
    spark = bins.sparkSession
    ratio = (f1 / f0) ** (1 / n_bands)
    edges = [(k, f0 * ratio**k, f1 if k == n_bands - 1 else f0 * ratio ** (k + 1), k == n_bands - 1) for k in range(n_bands)]
    bands = spark.createDataFrame(edges, "band long, lo double, hi double, last boolean")
    hit = bins.join(F.broadcast(bands), F.expr("freq >= lo and (freq < hi or (last and freq <= hi))"))
    mean = hit.groupBy("vec_id", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("gain_db").alias("g"))
    w = W.partitionBy("vec_id")
    return mean.select("vec_id", "band", "n", F.round(F.col("g") - F.median("g").over(w), 6).alias("gain_db"), F.round(F.max("g").over(w) - F.min("g").over(w), 6).alias("flatness_db"))
