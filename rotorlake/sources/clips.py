"""Clips on disk: listing by path, and decoding inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dsp import SR, BadAudio, decode_pcm, decode_wav

_PATH = r"/([^/]+)/(id_[^/]+)/(normal|abnormal)/([^/]+\.wav)$"


def list_clips(spark: SparkSession, root: str, snr: str, machines: list[str] | None = None) -> DataFrame:
    """path, snr, machine, machine_id, label of ``{root}/{snr}/{machine}/id_*/{normal,abnormal}/*.wav``, sorted.

    Only names are listed; no byte of a clip is read.  A missing level folder is Spark's own path error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(f"{root}/{snr}").select("path")
    part = lambda k: F.regexp_extract("path", _PATH, k)
    rows = files.select("path", F.lit(snr).alias("snr"), part(1).alias("machine"), part(2).alias("machine_id"), part(3).alias("label"), part(4).alias("name")).where("machine <> ''")
    rows = rows.where(F.col("machine").isin(machines)) if machines else rows
    return rows.orderBy("machine", "machine_id", "label", "name").drop("name")


def read_clips(spark: SparkSession, clips: DataFrame, root: str, sr: int = SR) -> DataFrame:
    """The clips with samples, and error (null if decoded); files are decoded where they are read."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root).select("path", "content")
    rows = clips.join(content, "path")
    keep = [c for c in rows.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                samples, error = None, None
                try:
                    samples = decode_wav(b.column("content")[i].as_py(), sr)
                except BadAudio as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in keep), pa.array([samples], pa.list_(pa.float32())), pa.array([error], pa.string())], names=[*keep, "samples", "error"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("content").schema) + ", samples array<float>, error string"
    return rows.select(*keep, "content").mapInArrow(run, schema)


def decode_frames(rows: DataFrame, column: str = "pcm") -> DataFrame:
    """Adds samples, decoded from 16-bit PCM bytes (null stays null)."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            samples = [None if x is None else decode_pcm(x) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(samples, pa.list_(pa.float32()))], names=[*names, "samples"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", samples array<float>"
    return rows.mapInArrow(run, schema)
