"""The given tables seen as clips, frames, taps, sidecars and captures; the same views in Spark and in SQL.

No recordings are supplied, so every job reads one of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, machine, machine_id, label, path, v."""
    e = read(spark, sf_dir, "embeddings")
    machine = F.when(F.col("label") % 2 == 0, "fan").otherwise("pump")
    machine_id = F.concat(F.lit("id_"), F.lpad(F.col("label").cast("string"), 2, "0"))
    label = F.when(F.col("vec_id") % 4 == 0, "abnormal").otherwise("normal")
    path = F.concat_ws("/", F.lit("0dB"), machine, machine_id, label, F.concat(F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".wav")))
    return e.select("vec_id", machine.alias("machine"), machine_id.alias("machine_id"), label.alias("label"), path.alias("path"), F.col("embedding").cast("array<double>").alias("v"))


def degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, v of the clips recorded again: two in three, the vector reversed."""
    return clips(spark, sf_dir).where("vec_id % 3 <> 0").select("path", F.reverse("v").alias("v"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, stream_id, seq (from 0), t (seconds, seq + 1), ts, raw, kind."""
    e = read(spark, sf_dir, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("event_id", F.col("user_id").alias("stream_id"), seq.cast("long").alias("seq"), "ts", F.col("value").alias("raw"), F.col("event_type").alias("kind")).withColumn("t", F.col("seq") + F.lit(1.0))


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.select("doc_id", "lang", "source", "n_chars").join(n, "doc_id", "left").select(
        "doc_id",
        F.col("lang").alias("machine_type"),
        F.col("source").alias("site_tag"),
        F.when(F.col("quality") == 1, "normal").when(F.col("quality") == 0, " ").alias("condition"),
        F.when(F.col("doc_id") % 3 == 0, "bearing").otherwise("").alias("suspected_fault"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("contains_speech"),
        F.lit(16000).cast("long").alias("sr"),
        (F.col("n_chars") * 32).alias("n_samples"),
        ((F.col("doc_id") % 1000) / 999.0).alias("peak_abs"),
        (F.col("doc_id") % 50 == 0).alias("clipped"),
    )


VIEWS = """
clips AS (
  SELECT vec_id, machine, machine_id, label, '0dB/' || machine || '/' || machine_id || '/' || label || '/' || lpad(vec_id::VARCHAR, 8, '0') || '.wav' AS path, v
  FROM (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'fan' ELSE 'pump' END AS machine, 'id_' || lpad(label::VARCHAR, 2, '0') AS machine_id,
               CASE WHEN vec_id % 4 = 0 THEN 'abnormal' ELSE 'normal' END AS label, embedding::DOUBLE[] AS v FROM embeddings)),
degraded AS (SELECT path, list_reverse(v) AS v FROM clips WHERE vec_id % 3 <> 0),
frames AS (
  SELECT event_id, user_id AS stream_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS seq, ts, value AS raw, event_type AS kind,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS t
  FROM events),
sidecars AS (
  SELECT d.doc_id, lang AS machine_type, source AS site_tag, CASE quality WHEN 1 THEN 'normal' WHEN 0 THEN ' ' END AS condition,
         CASE WHEN d.doc_id % 3 = 0 THEN 'bearing' ELSE '' END AS suspected_fault, coalesce(toxic = 1, false) AS contains_speech, 16000::BIGINT AS sr,
         n_chars * 32 AS n_samples, (d.doc_id % 1000) / 999.0::DOUBLE AS peak_abs, d.doc_id % 50 = 0 AS clipped
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

#: Clips with their side of the split, as ``splits.anomaly_split`` deals them.
SPLIT = """
split AS (
  SELECT c.*, CASE WHEN label = 'abnormal' THEN 'test_abnormal' WHEN rn <= n_abnormal THEN 'test_normal' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY machine, machine_id, label ORDER BY md5('1337:' || path), path) AS rn,
               count(*) FILTER (label = 'abnormal') OVER (PARTITION BY machine, machine_id) AS n_abnormal FROM clips) c)
"""

#: Scores of the test clips by mean cosine distance to the two nearest train clips of their machine id.
SCORES = """
unit AS (SELECT vec_id, machine, machine_id, split, list_transform(v, lambda x: CASE WHEN n = 0 THEN 0 ELSE x / n END) AS u
         FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM split)),
pairs AS (SELECT q.vec_id, q.machine, q.machine_id, q.split, greatest(0, least(2, 1 - list_dot_product(q.u, t.u))) AS d,
                 row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(0, least(2, 1 - list_dot_product(q.u, t.u))), t.vec_id) AS rn
          FROM unit q JOIN unit t ON q.machine = t.machine AND q.machine_id = t.machine_id AND q.split <> 'train' AND t.split = 'train'),
scores AS (SELECT vec_id, machine, machine_id, (split = 'test_abnormal')::INT AS y, round(avg(d), 9) AS score FROM pairs WHERE rn <= 2 GROUP BY ALL)
"""


def sql(query: str, *parts: str, recursive: bool = False) -> str:
    """A query after the views and the parts it builds on."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([VIEWS, *parts]) + "\n" + query
