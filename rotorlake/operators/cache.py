"""Features of files, kept in a store and worked out again only for files that are new or have changed.

A file is told by path, size and time of modification.  The store is partitioned by kind and hash of the path; a refresh
rewrites the partitions that hold a new, changed or vanished file, and no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import written

PARTS = 64


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, length, modificationTime, content; what is not asked for is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def refresh(spark: SparkSession, root: str, store: str, kind: str, compute: Callable[[DataFrame], DataFrame], values: str, pattern: str = "*.wav", parts: int = PARTS) -> dict[str, int]:
    """Bring ``store`` up to date with the files under ``root``; counts of computed, kept and gone files.

    ``compute`` gives path and the columns of the schema ``values`` for rows(path, content).  Only files at least as new as
    the oldest one to be computed are opened; ``load`` reads the store in order of path.
    """
    schema = f"path string, size long, changed timestamp, {values}, part int, kind string"
    there = files(spark, root, pattern).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))
    old = (spark.read.schema(schema).option("basePath", store).parquet(store) if exists(spark, store) else spark.createDataFrame([], schema)).where(F.col("kind") == kind)
    known = old.select("path", F.col("size").alias("old_size"), F.col("changed").alias("old_changed"), F.lit(True).alias("had"))
    both = there.withColumn("there", F.lit(True)).join(known, "path", "full")
    state = F.when(F.col("there").isNull(), "gone").when(F.col("had") & (F.col("size") == F.col("old_size")) & (F.col("changed") == F.col("old_changed")), "kept").otherwise("computed")
    plan = written(both.select("path", "size", "changed", state.alias("state"), F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int").alias("part")), "refresh")
    counts = {r.state: r.n for r in plan.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {name: counts.get(name, 0) for name in ("computed", "kept", "gone")}
    touched = [r.part for r in plan.where("state <> 'kept'").select("part").distinct().collect()]
    if not touched:
        return out
    todo = plan.where("state = 'computed'")
    since = todo.agg(F.min("changed")).first()[0]
    names = ["path", "size", "changed", *[x.split()[0] for x in values.split(", ")], "part", "kind"]
    stays = old.where(F.col("part").isin(touched)).join(plan.where("state = 'kept'").select("path"), "path", "left_semi").select(*names)
    rows = stays
    if since is not None:
        content = files(spark, root, pattern).where(F.col("modificationTime") >= F.lit(since)).select("path", "content")
        made = compute(content.join(todo.select("path"), "path", "left_semi"))
        rows = made.join(todo.select("path", "size", "changed", "part"), "path").withColumn("kind", F.lit(kind)).select(*names).unionByName(stays)
    # a partition whose files have all gone gets no rows and is removed
    left = written(rows, "features")
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "part").parquet(store)
    filled = {r.part for r in left.select("part").distinct().collect()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in set(touched) - filled:
        at = jvm.org.apache.hadoop.fs.Path(f"{store}/kind={kind}/part={p}")
        at.getFileSystem(conf).delete(at, True)
    return out


def load(spark: SparkSession, store: str, kind: str) -> DataFrame:
    return spark.read.option("basePath", store).parquet(store).where(F.col("kind") == kind).drop("part", "kind").orderBy("path")
