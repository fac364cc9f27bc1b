"""Quality reports on labelled field recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CLIPPED_PEAK, SHORT_S, condition_label, nonempty, sanitize


def ingest_rows(sidecars: DataFrame) -> DataFrame:
    """Sidecars with defaults filled in and the duration taken from samples, then the stored one, then 0."""
    duration = F.when((F.col("n_samples") > 0) & (F.col("sr") > 0), F.col("n_samples") / F.col("sr"))
    stored = F.col("duration_s") if "duration_s" in sidecars.columns else F.lit(None).cast("double")
    return sidecars.select(
        "doc_id",
        nonempty(F.col("machine_type"), F.lit("unknown")).alias("machine_type"),
        condition_label(F.col("condition"), F.col("suspected_fault")).alias("condition"),
        nonempty(F.col("site_tag"), F.lit("unlabeled")).alias("site_tag"),
        F.coalesce("contains_speech", F.lit(False)).alias("contains_speech"),
        F.coalesce(duration, stored, F.lit(0.0)).alias("duration_s"),
        F.coalesce("peak_abs", F.lit(0.0)).alias("peak_abs"),
        F.coalesce("clipped", F.lit(False)).alias("clipped"),
    )


def ingest_flags(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"short": F.col("duration_s") < SHORT_S, "clipped": F.col("clipped") | (F.col("peak_abs") >= CLIPPED_PEAK), "export_eligible": ~F.col("contains_speech")})


def ingest_summary(flags: DataFrame) -> DataFrame:
    """field, value, clips, minutes for machine types, conditions and site tags in one pass; most clips first."""
    fields = ["machine_type", "condition", "site_tag"]
    out = flags.groupingSets([[f] for f in fields], *fields).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("clips"), F.round(F.sum("duration_s") / 60, 6).alias("minutes"))
    field = F.when(F.col("g") == 3, fields[0]).when(F.col("g") == 5, fields[1]).otherwise(fields[2])
    return out.select(field.alias("field"), F.coalesce(*fields).alias("value"), "clips", "minutes").orderBy(F.desc("clips"), "field", "value")


def ingest_totals(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count(F.lit(1)).alias("clips"), F.round(F.sum("duration_s") / 60, 6).alias("minutes"), F.count_if("contains_speech").alias("speech"), F.count_if("short").alias("short"), F.count_if("clipped").alias("clipped"))


def label_rows(requests: DataFrame) -> DataFrame:
    """Rows to be written for labelled clips: derived duration, peak and flags; the client's clipped flag counts too."""
    rows = ingest_rows(requests)
    return rows.join(requests.select("doc_id", F.coalesce("client_clipped", F.lit(False)).alias("client_clipped")), "doc_id").select(
        "doc_id", "machine_type", sanitize(F.col("site_tag"), "unlabeled").alias("site_tag"), F.round("duration_s", 6).alias("duration_s"), (F.col("clipped") | F.col("client_clipped") | (F.col("peak_abs") >= CLIPPED_PEAK)).alias("clipped"), F.col("contains_speech").alias("public_dataset_default_excluded")
    )
