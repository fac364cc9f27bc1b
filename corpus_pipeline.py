"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, source mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  Every stage but the
last returns the columns of ``documents``; the last returns what it reads back from the token files.

Rows are told apart by id and two hashes of the text, so that one id may stand for several texts and rows with
null ids are treated like all others; extra columns of the input are ignored, whatever their names.  Every stage
gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorlake.llm import decontaminate, mixing, near_join, quality, token_files
from rotorlake.llm.common import materialise, new_folder, read, same_row, text_keys

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What tells rows apart: the id and two hashes of the text.
KEY = ["doc_id", "t1", "t2"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base test or a certified rule rejects.

    Cutoffs are certified together on the labelled rows of this stage's input; verdicts are by text and language,
    row by row.  Null and empty texts fail the base test; repeated rows all stay or all go.
    """
    measured = materialise(quality.measure(docs), "figures")
    cutoffs = materialise(quality.joint_thresholds(measured, quality.good_documents(read(spark, sf_dir, "labels"))), "cutoffs")
    return quality.filter_documents(docs.select(*COLUMNS), cutoffs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each near-duplicate group, by id (null last); of repeated rows one stays.

    Texts without words belong to no group.  Ties between texts of one id go by hash of the text.
    """
    docs = docs.select(*COLUMNS)
    rows = materialise(near_join.near_rows(docs), "near-classes")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t1", "t2")
    joined = rows.where("n_links > 0").withColumn("row", row)
    # by row, not by class: a class may hold a third of all rows
    first = joined.groupBy("class_key").agg(F.min("row").alias("first")).select(*[F.col(f"first.{k}").alias(f"k_{k}") for k in KEY])
    leave = joined.select(*KEY).distinct().join(first, same_row(), "left_anti")
    leave = materialise(leave.toDF(*[f"k_{k}" for k in KEY]), "copies")
    kept = near_join.without_rows(docs.withColumns(dict(zip(KEY[1:], text_keys()))), leave)
    repeated = materialise(rows.groupBy(*KEY).count().where("count > 1").select(*KEY).toDF(*[f"k_{k}" for k in KEY]), "repeated")
    if not repeated.take(1):
        return kept.select(*COLUMNS)
    once = kept.join(repeated, same_row(), "left_semi").dropDuplicates(KEY)
    return kept.join(repeated, same_row(), "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose own text overlaps an item of the benchmark; null and empty texts stay."""
    keyed = docs.select(*COLUMNS).withColumns(dict(zip(KEY[1:], text_keys())))
    found = decontaminate.contaminated(keyed, read(spark, sf_dir, "benchmark"), key=tuple(KEY))
    found = materialise(found.select(*KEY).distinct().toDF(*[f"k_{k}" for k in KEY]), "contaminated")
    return near_join.without_rows(keyed, found).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once, or repeated.

    Repeated rows (equal id, text and source) are taken together, as often as the mix takes all of them; texts
    without words have no size and are never taken.
    """
    copies = mixing.mix(docs).groupBy(*KEY, "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    names = [f"k_{k}" for k in KEY]
    copies = materialise(copies.where("copies > 0").select(*[F.col(k).alias(n) for k, n in zip(KEY, names)], F.col("source").alias("m_source"), F.col("copies").cast("int").alias("copies"), "rows"), "mix-copies")
    # a row per document on both sides: always a shuffle join, as copies grow with the documents
    rows = docs.select(*COLUMNS).withColumns(dict(zip(KEY[1:], text_keys())))
    rows = rows.join(copies.hint("merge"), same_row() & F.col("source").eqNullSafe(F.col("m_source")))
    if copies.where("rows > 1").take(1):
        rows = rows.where("rows = 1").unionByName(rows.where("rows > 1").dropDuplicates([*KEY, "source"]))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold: doc_id, start, n_tokens, ids_crc32.

    Every row is written; rows of equal id stand side by side, null ids come first.
    """
    return token_files.tokens(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
    ("token files", token_output),
]

#: Tokenisation cannot be written in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
