"""What the operators of this subpackage share: shared folder, materialised tables, row ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as named by ``spark.checkpoint.dir``.

    Only in local mode, where the setting is absent (tests), a fresh temporary folder is set and used; on a cluster
    that is an error.  The path is qualified by Spark's own file systems, so that tasks that open files by it and
    Spark's writers mean the same place.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("rotorlake.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="rotorlake-")
        spark.conf.set("rotorlake.shared.dir", path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/rotorlake-{name}-{uuid.uuid4().hex[:12]}"


#: Rows that an Arrow batch of texts holds at most.
TEXT_BATCH = 2000


def text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small: texts are long, and every worker holds a batch twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH:
        spark.conf.set(key, TEXT_BATCH)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/rotorlake-" in path:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_keys() -> list[Column]:
    """``t1``, ``t2``: two hashes of the text.  With the id they tell rows apart; rows equal in all three are repeated."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")]


def same_row(other: str = "k_") -> Column:
    """Join condition on id and text between docs with ``text_keys`` and a table whose keys begin with ``other``."""
    return F.col("doc_id").eqNullSafe(F.col(f"{other}doc_id")) & (F.col("t1") == F.col(f"{other}t1")) & (F.col("t2") == F.col(f"{other}t2"))
