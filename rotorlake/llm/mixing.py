"""Operator 4: mixing sources to target weights by weighted fair queueing.  [DataFrame functions only]

Every document of a source stands up to ``max_epochs`` times in its source's queue, each round in
the same shuffled order (md5 of the id).  The virtual finish time of a copy is the source's
cumulative words divided by the source's weight.  Serving copies by finish time until the total
budget is used gives each source words in proportion to its weight, and a source whose queue runs
dry leaves its share to the others by weight.

The cumulative sums are prefix sums over fixed slices, so no source and no stretch of the global
order has to fit one task: in-source order is cut into slices by the leading hex digits of the md5,
the global order into equal slices of virtual time (the queue serves words at a nearly constant
rate, so such slices hold nearly equal work).  Only slice totals meet in one window.

Null texts and texts without words have size 0 and are never taken; null sources form a source of
their own, placed last; repeated rows (same id) count as separate documents with the same place
in the shuffle, ties between them broken by size (in a slice of more than ``HOT_ROWS`` rows, by hash of the text
first); very long texts are documents like others; extra columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import materialise, read, text_keys

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BEGIN = r"[\x20\x09-\x0D][^\x20\x09-\x0D]"
#: Slices of a source's order are 16**SLICE_DIGITS.
SLICE_DIGITS = 3
#: Slices of more rows (one id may have many) are cut further, by the whole md5 and then by hash of the text.
HOT_ROWS = 1_000_000


def n_words(text: Column) -> Column:
    """Number of runs of other than white space: places where one begins."""
    return F.coalesce(F.regexp_count(F.concat(F.lit(" "), text), F.lit(BEGIN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, budget_share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: weight, size and target; the level of the water that fills all sources.

    Targets are ``min(max_epochs * size, weight * level)`` where the level makes them add up to the budget.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    picked = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(picked, (F.col("rank") % len(weights) + 1).cast("int")))
    most = F.lit(float(max_epochs)) * F.col("source_size")
    by_level = W.orderBy(most / F.col("weight"), "rank")
    everything = W.partitionBy(F.lit(1))
    filled = (
        ranked.withColumn("budget", F.lit(float(budget_share)) * F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum(most).over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level_here", (F.col("budget") - F.col("full")) / F.col("open"))
    )
    # the first source, by the level at which it is full, that the water does not fill
    level = F.min(F.when(F.col("level_here") <= most / F.col("weight"), F.struct(most / F.col("weight"), "rank", "level_here"))).over(everything)
    filled = filled.withColumn("level", F.coalesce(level["level_here"], F.max(most / F.col("weight")).over(everything)))
    return filled.withColumn("target", F.least(most, F.col("weight") * F.col("level"))).select("source", "source_size", "weight", "target", "budget", "level")


def mix(docs: DataFrame, weights=WEIGHTS, budget_share: float = 1.0, max_epochs: int = MAX_EPOCHS, slices: int = 4096) -> DataFrame:
    """row_no, doc_id, source, t1, t2, size, source_size, target, copies, taken for every row of docs(doc_id, text, source).

    ``t1`` and ``t2`` are hashes of the text, which tell rows of one id apart.
    """
    sized = materialise(
        docs.select(
            "doc_id",
            "source",
            *text_keys(),
            n_words(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffle"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "sizes",
    )
    targets = materialise(source_targets(sized, weights, budget_share, max_epochs), "targets")
    up_to_here = (W.unboundedPreceding, W.currentRow)

    # place in the source's shuffled order: prefix sums over slices, then inside each slice
    sliced = sized.withColumn("slice", F.substring("shuffle", 1, SLICE_DIGITS)).withColumn("part", F.lit(""))
    hot = sliced.groupBy("source", "slice").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS)
    hot = materialise(hot.select(F.col("source").alias("h_source"), F.col("slice").alias("h_slice")), "hot-slices")
    if hot.take(1):
        sliced = sliced.join(hot, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("slice") == F.col("h_slice")), "left")
        part = F.when(F.col("h_slice").isNotNull(), F.lpad(F.hex(F.shiftrightunsigned("t1", 52)), 3, "0")).otherwise("")
        sliced = sliced.withColumn("part", part).withColumn("slice", F.when(F.col("h_slice").isNotNull(), F.concat("shuffle", "part")).otherwise(F.col("slice")))
    before = materialise(
        sliced.groupBy("source", "slice")
        .agg(F.sum("size").alias("slice_size"))
        .select(
            F.col("source").alias("b_source"),
            F.col("slice").alias("b_slice"),
            (F.sum("slice_size").over(W.partitionBy("source").orderBy("slice").rowsBetween(*up_to_here)) - F.col("slice_size")).alias("before"),
        ),
        "slices",
    )
    by_slice = W.partitionBy("source", "slice").orderBy("shuffle", "doc_id", "part", "size", "row_no").rowsBetween(*up_to_here)
    placed = (
        sliced.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("slice") == F.col("b_slice")))
        .withColumn("cumulative", F.col("before") + F.sum("size").over(by_slice))
        .join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
        .select("row_no", "doc_id", "source", "t1", "t2", "size", "shuffle", "source_size", "weight", "target", "budget", "level", "cumulative")
    )
    placed = materialise(placed, "placed")

    # the global order: all copies on the virtual clock, cut into equal slices of its time;
    # slices that begin after the budget is used need no sort
    copies = (
        placed.where("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
        .withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("cumulative")) / F.col("weight"))
        .withColumn("tick", F.floor(F.least(F.col("finish") / F.greatest(F.col("level"), F.lit(1e-9)), F.lit(2.0)) * slices).cast("long"))
        .select("row_no", "shuffle", "doc_id", "source", "size", "epoch", "finish", "tick", "budget")
    )
    served = materialise(
        copies.groupBy("tick")
        .agg(F.sum("size").alias("tick_size"))
        .select("tick", (F.sum("tick_size").over(W.orderBy("tick").rowsBetween(*up_to_here)) - F.col("tick_size")).alias("served")),
        "ticks",
    )
    by_tick = W.partitionBy("tick").orderBy("finish", "shuffle", "doc_id", "source", "size", "epoch", "row_no").rowsBetween(*up_to_here)
    taken = copies.join(served, "tick").where("served < budget").withColumn("end", F.col("served") + F.sum("size").over(by_tick)).where("end <= budget").groupBy("row_no").agg(F.count(F.lit(1)).alias("copies"))
    return placed.join(taken, "row_no", "left").select(
        "row_no",
        "doc_id",
        "source",
        "t1",
        "t2",
        "size",
        "source_size",
        "target",
        F.coalesce("copies", F.lit(0)).cast("long").alias("copies"),
        (F.coalesce("copies", F.lit(0)) * F.col("size")).cast("long").alias("taken"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS shuffle,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per),
filled AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, sum(source_size) OVER ()::DOUBLE AS budget,
    coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
  FROM ranked),
lvl AS (SELECT arg_min((budget - full_) / open_, most / weight) AS level FROM filled WHERE (budget - full_) / open_ <= most / weight),
targets AS (SELECT source, source_size, weight, budget, least(most, weight * level)::DOUBLE AS target FROM filled, lvl),
placed AS (
  SELECT s.*, t.source_size, t.weight, t.target, t.budget,
    sum(size) OVER (PARTITION BY s.source ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS cumulative
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, (epoch * source_size + cumulative)::DOUBLE / weight AS finish
  FROM placed, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0),
ends AS (
  SELECT doc_id, size, budget, sum(size) OVER (ORDER BY finish, shuffle, doc_id, source, size, epoch ROWS UNBOUNDED PRECEDING) AS end_ FROM copies),
taken AS (SELECT doc_id, count(*) AS n FROM ends WHERE end_ <= budget GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, (coalesce(n, 0) * p.size)::BIGINT AS taken
FROM placed p LEFT JOIN taken USING (doc_id)
"""
