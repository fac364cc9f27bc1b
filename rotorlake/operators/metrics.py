"""Exact ROC AUC and partial AUC per group, averages and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import running_sums
from .tables import written

KEYS = ["machine", "machine_id"]
MAX_FPR = 0.1
SANE = (0.55, 0.98)


def by_score(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives at each distinct score; all that the curves need, much smaller than the rows."""
    return scores.groupBy(*keys, "score").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def curve(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct scores with pos, neg, below_pos, below_neg (rows of lower scores), all_pos and all_neg.

    Scores are dealt by range and their sums put together over slices, so one id with most of the rows is no single task.
    """
    return running_sums(by_score(scores, keys), keys, ["score"], ["pos", "neg"])


def auc_of(c: DataFrame, keys: list[str]) -> DataFrame:
    won = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
    out = c.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("won"))
    return out.select(*keys, "n_pos", "n_neg", (F.col("won") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def pauc_of(c: DataFrame, keys: list[str], max_fpr: float) -> DataFrame:
    c = c.where("all_pos > 0 and all_neg > 0").selectExpr(*keys, "(all_neg - below_neg) / all_neg as x1", "(all_neg - below_neg - neg) / all_neg as x0", "(all_pos - below_pos) / all_pos as y1", "(all_pos - below_pos - pos) / all_pos as y0").where(F.col("x0") < max_fpr)
    x1 = F.least(F.col("x1"), F.lit(max_fpr))
    y1 = F.when(F.col("x1") > F.col("x0"), F.col("y0") + (F.col("y1") - F.col("y0")) * (x1 - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(F.col("y1"))
    low = 0.5 * max_fpr**2
    area = F.sum((x1 - F.col("x0")) * (F.col("y0") + y1) / 2)
    return c.groupBy(*keys).agg((0.5 * (1 + (area - low) / (max_fpr - low))).alias("pauc"))


def auc(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, n_pos, n_neg, auc; tied scores count half (the area under the ROC curve)."""
    return auc_of(curve(scores, keys), keys)


def pauc(scores: DataFrame, keys: list[str] = KEYS, max_fpr: float = MAX_FPR) -> DataFrame:
    """keys, pauc: area up to a false positive rate, standardized so that chance is 0.5 and perfect 1.

    Each distinct score is one straight piece of the curve; pieces are cut at the limit by interpolation.
    """
    return pauc_of(curve(scores, keys), keys, max_fpr)


def metrics(scores: DataFrame, keys: list[str] = KEYS, max_fpr: float = MAX_FPR) -> DataFrame:
    """keys, n_pos, n_neg, auc, pauc from one curve, written once."""
    c = written(curve(scores, keys), "curve")
    return auc_of(c, keys).join(pauc_of(c, keys, max_fpr), keys)


def type_averages(results: DataFrame, keys: list[str] = ["machine"]) -> DataFrame:
    """Unweighted means over ids."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ids"), F.avg("auc").alias("auc"), F.avg("pauc").alias("pauc"))


def sanity_gate(averages: DataFrame, published: dict[str, float], band: tuple[float, float] = SANE) -> DataFrame:
    """machine, auc, sane (inside the band), delta to the published value (null if none)."""
    known = F.coalesce(*[F.when(F.col("machine") == m, F.lit(v)) for m, v in published.items()])
    return averages.select("machine", "auc", F.col("auc").between(*band).alias("sane"), (F.col("auc") - known).alias("delta"))


def determinism(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per metric: how many groups were compared and how many differ after rounding to 3 places."""
    def long(df):
        pairs = ", ".join(f"'{v}', round({v}, 3)" for v in values)
        return df.selectExpr(*keys, f"stack({len(values)}, {pairs}) as (metric, value)")

    both = long(a).join(long(b).withColumnRenamed("value", "again"), [*keys, "metric"], "full")
    return both.groupBy("metric").agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("value").eqNullSafe(F.col("again"))).alias("differing"))
