"""Frames as they come over the wire: base64 text to bytes, judged without failing the job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 2 * 32_000


def judge(rows: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds pcm and verdict (ok, not base64, odd, too long) to rows with pcm_b64; bad rows keep a null pcm."""
    b = F.try_to_binary(F.col("pcm_b64"), F.lit("base64"))
    n = F.octet_length(F.col("_b"))
    verdict = F.when(F.col("_b").isNull(), "not base64").when(n % 2 == 1, "odd").when(n > max_bytes, "too long").otherwise("ok")
    return rows.withColumn("_b", b).withColumn("verdict", verdict).withColumn("pcm", F.when(F.col("verdict") == "ok", F.col("_b"))).drop("_b")


def good(rows: DataFrame) -> DataFrame:
    return rows.where("verdict = 'ok'")


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.where("verdict <> 'ok'")
