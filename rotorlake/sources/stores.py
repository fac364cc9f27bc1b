"""Parquet stores with one partition per key: baselines by tag, results by condition, labelled clips by site."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import TAG


def replace(df: DataFrame, path: str, key: str) -> None:
    """Writes the rows of the keys that df holds and leaves other keys as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def save_baseline(df: DataFrame, path: str) -> None:
    """Replaces the baselines of the tags in df; a tag with other than letters, digits and ._- is an error."""
    ok = F.when(F.col("tag").rlike(TAG), F.col("tag")).otherwise(F.raise_error(F.concat(F.lit("not a tag: "), F.coalesce("tag", F.lit("null")))))
    replace(df.withColumn("tag", ok), path, "tag")


def load_baseline(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One tag's rows, reading only its partition; a missing tag is an error."""
    rows = spark.read.option("basePath", path).parquet(path).where(F.col("tag") == tag)
    if not rows.take(1):
        raise KeyError(f"no baseline named {tag}")
    return rows


def tags(df: DataFrame) -> DataFrame:
    return df.select("tag").distinct().orderBy("tag")


def save_condition(df: DataFrame, path: str) -> None:
    replace(df, path, "condition")


def append_clips(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("site_tag").parquet(path)


# stores that a stream keeps


def handled(spark: SparkSession, ledger: str, query: str, batch: int) -> bool:
    """Whether the ledger has the batch, or a later one, of this query."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return False
    return bool(spark.read.schema("query string, batch long").parquet(ledger).where((F.col("query") == query) & (F.col("batch") >= batch)).take(1))


def write_once(path: str, key: str, version: str, query: str, save: Callable[[DataFrame, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that leaves each key with the rows of its newest version, once.

    The batch's newest version of each key replaces the key's partition, then the ledger beside the store notes the batch.
    A batch that was interrupted is written again whole, which replaces what it had left; one that the ledger has, or that is
    older than one it has, changes nothing.  ``save``(rows, path) does the replacing, by default ``replace``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, ledger = batch.sparkSession, f"{path.rstrip('/')}-ledger"
        if handled(spark, ledger, query, number):
            return
        newest = batch.groupBy(F.col(key).alias("_key")).agg(F.max(version).alias("_newest"))
        rows = batch.join(newest, F.col(key).eqNullSafe(F.col("_key")) & F.col(version).eqNullSafe(F.col("_newest"))).drop("_key", "_newest")
        (save or (lambda df, to: replace(df, to, key)))(rows, path)
        spark.createDataFrame([(query, number)], "query string, batch long").coalesce(1).write.mode("append").parquet(ledger)

    return write


def keep(stream: DataFrame, path: str, key: str, version: str, query: str, checkpoint: str, save: Callable[[DataFrame, str], None] | None = None) -> StreamingQuery:
    """Keep a store up to date with a stream of rows(key, version, ...), for what is there now."""
    writer = stream.writeStream.foreachBatch(write_once(path, key, version, query, save)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def baselines_of(sessions: DataFrame, path: str) -> DataFrame:
    """stream_id and baseline columns of sessions(stream_id, tag), each under its saved tag; a tag that is not there is an error."""
    spark = sessions.sparkSession
    saved = spark.read.option("basePath", path).parquet(path)
    known = saved.withColumn("_there", F.lit(True)).drop("stream_id")
    rows = sessions.select("stream_id", F.col("tag").alias("_tag")).join(known, F.col("tag") == F.col("_tag"), "left")
    sure = F.when(F.col("_there"), F.col("stream_id")).otherwise(F.raise_error(F.concat(F.lit("no baseline named "), F.coalesce("_tag", F.lit("null")))))
    return rows.withColumn("stream_id", sure.cast(sessions.schema["stream_id"].dataType)).drop("_tag", "_there")
