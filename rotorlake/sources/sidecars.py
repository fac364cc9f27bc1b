"""Sidecar documents of field recordings; corrupt ones are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDECAR = (
    "machine_type string, condition string, suspected_fault string, contains_speech boolean, note string, site_tag string, session_id string, duration_s double, peak_abs double, "
    "clipped boolean, client_recorded_at string, client_duration_s double, client_peak_abs double, client_clipped boolean, public_dataset_default_excluded boolean, sr long, n_samples long, created_at string"
)


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """One row per JSON file under a folder, of a fixed schema; files that do not parse are left out."""
    rows = spark.read.schema(SIDECAR + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.select("*", F.col("_metadata.file_path").alias("path")).where("_corrupt_record is null").drop("_corrupt_record")


def parse(rows: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """Adds the schema's columns from a JSON text column; rows that do not parse are left out."""
    parsed = F.from_json(column, schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.withColumn("_j", parsed).where("_j is not null and _j._corrupt_record is null").select("*", "_j.*").drop("_j", "_corrupt_record")
