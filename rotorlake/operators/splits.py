"""Leakage-free splits, quotas and audits over clips (machine, machine_id, label, path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .baseline import mean_vector
from .tables import written

KEYS = ["machine", "machine_id"]
#: Numbers of the centroids that one pass over the rows may be sent.
MODEL_VALUES = 1 << 21


def anomaly_split(clips: DataFrame, seed: int = 1337) -> DataFrame:
    """Adds split: every abnormal clip and as many normals of its id are tests, all other normals train.

    Normals are drawn by md5 of seed and path, so neither input order nor partitioning matters.  An id without
    more normals than abnormals has no train clip and is refused by ``split_guard``.  The draw works on paths and
    keys alone, in one shuffle by id; vectors meet its result in one join.
    """
    drawn = clips.select(*KEYS, "path", (F.col("label") == "abnormal").alias("_bad")).distinct()
    rank = F.row_number().over(W.partitionBy(*KEYS, "_bad").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "path")), "path"))
    drawn = drawn.withColumns({"_rank": rank, "_abnormal": F.count_if("_bad").over(W.partitionBy(*KEYS))})
    normal = drawn.where("not _bad and _rank > _abnormal")
    normal = normal.select(*[F.col(c).alias(f"_{c}") for c in [*KEYS, "path"]], F.lit("train").alias("_side"))
    side = F.when(F.col("label") == "abnormal", "test_abnormal").otherwise(F.coalesce("_side", F.lit("test_normal")))
    # paths are told apart by their machine: ids of different machines may use the same names
    same = [F.col(c) == F.col(f"_{c}") for c in [*KEYS, "path"]]
    rows = clips.join(normal, [*same, F.col("label") != "abnormal"], "left")
    return rows.withColumn("split", side).drop(*[f"_{c}" for c in [*KEYS, "path"]], "_side")


def split_guard(split: DataFrame) -> DataFrame:
    """The ids that cannot be split: fewer normals than abnormals + 1."""
    return split.groupBy(*KEYS).agg(F.count_if(F.col("label") == "normal").alias("n_normal"), F.count_if(F.col("label") == "abnormal").alias("n_abnormal")).where("n_normal < n_abnormal + 1")


def split_counts(split: DataFrame) -> DataFrame:
    """Counts per id, per machine and in all (null keys), and the median count of abnormal tests over ids."""
    counts = [F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "test_normal", "test_abnormal")]
    per_id = split.groupBy(*KEYS).agg(F.count_if(F.col("split") == "test_abnormal").alias("n"))
    middle = per_id.agg(F.median("n").alias("median_abnormal"))
    return split.rollup(*KEYS).agg(*counts).crossJoin(F.broadcast(middle))


def id_offsets(clips: DataFrame) -> DataFrame:
    """Each id's place in the sorted list of ids, from 0."""
    return clips.select(*KEYS).distinct().withColumn("id_offset", (F.dense_rank().over(W.orderBy(*KEYS)) - 1).cast("long"))


def first_by_name(clips: DataFrame, per_id: int) -> DataFrame:
    return clips.withColumn("_n", F.row_number().over(W.partitionBy(*KEYS, "label").orderBy("path"))).where(F.col("_n") <= per_id).drop("_n")


def subset_quota(clips: DataFrame, n: int) -> DataFrame:
    """Per id the first ceil(0.7 n) normals and n - that abnormals by name (in integers: 0.7 is not exact)."""
    normals = (7 * n + 9) // 10
    rank = F.row_number().over(W.partitionBy(*KEYS, "label").orderBy("path"))
    return clips.withColumn("_n", rank).where(F.col("_n") <= F.when(F.col("label") == "normal", normals).otherwise(n - normals)).drop("_n")


def restrict(split: DataFrame, ids: DataFrame) -> DataFrame:
    """Split rows of the requested ids; the split is made before, so sampling does not change."""
    return split.join(ids, KEYS, "left_semi")


def unknown_ids(split: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(split, KEYS, "left_anti")


def id_disjoint(clips: DataFrame, held_out: list[str]) -> DataFrame:
    """Adds part: val for clips of held-out machine ids, train for others."""
    return clips.withColumn("part", F.when(F.col("machine_id").isin(held_out), "val").otherwise("train"))


def audit(split: DataFrame) -> DataFrame:
    """Four counts that must be 0: overlaps of train and test, abnormal train clips, normals missing from or added to the split."""
    train, test = split.where("split = 'train'").select("path"), split.where("split <> 'train'").select("path")
    normals = split.where("label = 'normal'").select("path")
    dealt = split.where("split in ('train', 'test_normal')").select("path")
    checks = [("overlap", train.intersect(test)), ("abnormal_train", split.where("split = 'train' and label = 'abnormal'").select("path")), ("missing", normals.exceptAll(dealt)), ("added", dealt.exceptAll(normals))]
    out = None
    for name, rows in checks:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def standardize(rows: DataFrame, part: str = "part", vector: str = "v") -> DataFrame:
    """Vectors less the mean of all train values, by their sample deviation (1 if at most 1e-6)."""
    values = rows.where(F.col(part) == "train").select(F.explode(vector).alias("x"))
    stats = values.agg(F.avg("x").alias("_m"), F.stddev_samp("x").alias("_s")).withColumn("_s", F.when(F.col("_s") > 1e-6, F.col("_s")).otherwise(1.0))
    return rows.crossJoin(F.broadcast(stats)).withColumn(vector, F.transform(vector, lambda x: (x - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def centroid_accuracy(rows: DataFrame, target: str = "machine") -> DataFrame:
    """part, n, accuracy of the classifier that names the class with the nearest train centroid; ties by class.

    Centroids go to the rows in arrays of at most ``MODEL_VALUES`` numbers (one class at least), so vectors are neither
    taken apart nor shuffled; more classes take several passes.  Without train rows the accuracy is null.
    """
    centroids = written(mean_vector(rows.where("part = 'train'"), [target]), "centroids")
    n_values = centroids.agg(F.sum(F.size("mean"))).head()[0] or 0
    passes = max(1, -(-n_values // MODEL_VALUES))
    named = rows.select("path", "part", F.col(target).alias("_class"), "v", F.lit(None).cast(f"struct<d:double,c:{centroids.schema[target].dataType.simpleString()}>").alias("_best"))
    for k in range(passes):
        some = centroids.where(F.pmod(F.xxhash64(target), F.lit(passes)) == k)
        model = some.agg(F.collect_list(F.struct(F.col(target).alias("c"), "mean")).alias("_model"))
        gap = lambda m: F.aggregate(F.zip_with("v", m, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
        nearest = F.array_min(F.transform("_model", lambda m: F.struct(gap(m["mean"]).alias("d"), m["c"].alias("c"))))
        named = named.crossJoin(F.broadcast(model)).withColumn("_best", F.least("_best", nearest)).drop("_model")
    hit = (F.col("_best.c") == F.col("_class")).cast("double")
    return named.select("part", hit.alias("hit")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"))
