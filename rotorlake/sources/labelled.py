"""Labelled clips: WAV bytes and sidecar of each recording, appended to a store under names that nothing else has."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.scalars import CLIPPED_PEAK, peak, sanitize
from ..operators.cache import exists
from ..operators.guards import checked

STORE = "doc_id long, site_tag string, base string, n long, stem string, sr int, n_samples long, duration_s double, peak_abs double, clipped boolean, sidecar string, wav binary"


def wav_bytes(samples: np.ndarray, sr: int) -> bytes:
    """Mono 16-bit PCM; samples in -1..1, rounded half up and clamped."""
    pcm = np.clip(np.floor(np.nan_to_num(samples.astype(np.float64)) * 32768 + 0.5), -32768, 32767).astype("<i2").tobytes()
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, sr, 2 * sr, 2, 16) + b"data" + struct.pack("<I", len(pcm))
    return b"RIFF" + struct.pack("<I", len(head) + len(pcm)) + head + pcm


def clips_of(rows: DataFrame) -> DataFrame:
    """rows(doc_id, site_tag, created_at, sr, samples, ...) as rows of ``STORE`` but for n and stem; other columns go to the sidecar.

    A null or empty tag is ``unlabeled``; the given ``clipped``, if any, counts beside the peak.
    """
    own = ("doc_id", "created_at", "sr", "samples")
    told = F.coalesce("clipped", F.lit(False)) if "clipped" in rows.columns else F.lit(False)
    meta = [c for c in rows.columns if c not in own]
    top = F.coalesce(peak(F.col("samples")).cast("double"), F.lit(0.0))
    facts = {"n_samples": F.size("samples").cast("long"), "peak_abs": top, "clipped": told | (top >= CLIPPED_PEAK), "sr": F.col("sr").cast("int")}
    sidecar = F.to_json(F.struct(*meta, F.col("sr"), F.size("samples").alias("n_samples"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("created_at")))
    tag = sanitize(F.col("site_tag"), "unlabeled")
    rows = rows.withColumns({"sidecar": sidecar, "base": F.concat_ws("_", F.date_format("created_at", "yyyyMMdd_HHmmss"), tag), "tag": tag})
    rows = rows.select("doc_id", F.col("tag").alias("site_tag"), "base", "sidecar", "samples", *[c.alias(n) for n, c in facts.items()]).withColumn("duration_s", F.col("n_samples") / F.col("sr"))
    keep = [c for c in rows.columns if c != "samples"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a clip at a time: samples are long
                one = b.slice(i, 1)
                x = one.column("samples").flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in keep), pa.array([wav_bytes(x, one.column("sr")[0].as_py())], pa.binary())], names=[*keep, "wav"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("samples").schema)
    return rows.mapInArrow(pack, f"{kinds}, wav binary")


def append_labelled(rows: DataFrame, path: str, checks: str) -> DataFrame:
    """Append labelled clips to the store at ``path``, one partition for each tag; doc_id and stem of what was added.

    Clips of one tag and second get _1, _2, ... in order of doc_id, going on where the store ends.  A clip without samples,
    time or a positive rate is a fault (``guards.checked`` under ``checks``), and nothing is added.
    """
    spark = rows.sparkSession
    good = checked(rows, checks, {"no_samples": F.coalesce(F.size("samples"), F.lit(0)) < 1, "no_rate": F.coalesce("sr", F.lit(0)) < 1, "no_time": F.col("created_at").isNull()})
    made = clips_of(good)
    place = F.row_number().over(W.partitionBy("base").orderBy("doc_id")) - 1
    if exists(spark, path):
        old = spark.read.schema(STORE).option("basePath", path).parquet(path).groupBy(F.col("base").alias("_base")).agg((F.max("n") + 1).alias("_next"))
        made = made.join(old, F.col("base") == F.col("_base"), "left").withColumn("n", place + F.coalesce("_next", F.lit(0))).drop("_base", "_next")
    else:
        made = made.withColumn("n", place)
    made = made.withColumn("n", F.col("n").cast("long")).withColumn("stem", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string"))))
    names = [x.split()[0] for x in STORE.split(", ")]
    # written beside the checks first: stems must not be worked out again after the store has grown
    made.select(*names).write.mode("overwrite").parquet(f"{checks}-made")
    added = spark.read.schema(STORE).parquet(f"{checks}-made")
    added.write.mode("append").partitionBy("site_tag").parquet(path)
    return added.select("doc_id", "stem")
