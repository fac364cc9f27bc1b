"""Distances of new windows to an id's healthy windows: grouped nearest neighbours and shrunk covariance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine_distance, unit
from . import moments
from .baseline import mean_vector
from .neighbours import QUERY_WIDE, VALUES, Neighbours, parts
from .tables import written

KEYS = ["machine", "machine_id"]
#: Most blocks of an id's test rows as long as they are not wide.
TEST_PARTS = 8


def knn_scores(split: DataFrame, k: int = 2, strict: bool = False) -> DataFrame:
    """vec_id, keys, y, score: mean cosine distance to the k nearest train clips of the same id.

    Blocks of train rows that the triangle inequality rules out are not compared (``neighbours``); ``knn_scores_blocked``
    compares all.  Test rows of ids without train rows are left out and ids with fewer than k average what they have, or
    are an error if ``strict``; ``few_train_rows`` names them.
    """
    if strict and (few := few_train_rows(split, k).first()):
        raise ValueError(f"{few.machine} {few.machine_id} has {few.n_train} train rows, {k} are needed")
    test = split.where("split <> 'train'")
    near = Neighbours(split.where("split = 'train'"), KEYS, "vec_id").search(test, "vec_id", k)
    score = F.aggregate("near", F.lit(0.0), lambda a, x: a + x["d"]) / F.size("near")
    scored = near.select("vec_id", *KEYS, score.alias("score"))
    return scored.join(test.select("vec_id", *KEYS, (F.col("split") == "test_abnormal").cast("int").alias("y")), ["vec_id", *KEYS]).select("vec_id", *KEYS, "y", "score")


def few_train_rows(split: DataFrame, k: int) -> DataFrame:
    """keys, n_train of the ids with test rows but fewer than k train rows."""
    n = split.groupBy(*KEYS).agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") != "train").alias("n_test"))
    return n.where((F.col("n_train") < k) & (F.col("n_test") > 0)).drop("n_test")


def nearest(test: np.ndarray, train: np.ndarray, k: int) -> np.ndarray:
    """The k smallest cosine distances of each test row, sorted; zero vectors are at distance 1."""
    def norm(x):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    q, t, out = norm(test), norm(train).T, []
    k = min(k, len(train))
    stripe = max(1, VALUES // len(train))
    for lo in range(0, len(q), stripe):
        far = -(q[lo : lo + stripe] @ t)
        far.partition(k - 1, axis=1)
        out.append(np.sort(np.clip(1 + far[:, :k], 0, 2), axis=1))
    return np.concatenate(out)


def knn_scores_blocked(split: DataFrame, k: int = 2, block: int = 2048) -> DataFrame:
    """The same scores by matrix products over blocks of test and train rows.

    Both sides of an id are cut into blocks, so no task holds an id whole; each pair of blocks gives k distances per
    test row, and the k smallest over all blocks are kept.  Blocks have about ``block`` rows while the train side has two
    at most and the test side ``TEST_PARTS``, and then grow to ``QUERY_WIDE`` test rows and ``VALUES`` numbers of train rows,
    as a row travels once for each block of the other side.
    """
    n = split.groupBy(*KEYS).agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") != "train").alias("b"), F.greatest(F.lit(1), F.max(F.size("v"))).alias("size"))
    n = n.select(*KEYS, parts(F.col("a"), block, 2, VALUES / F.col("size")).alias("n_train"), parts(F.col("b"), block, TEST_PARTS, QUERY_WIDE).alias("n_test"))
    rows = split.join(n, KEYS)
    own = lambda m: F.pmod(F.xxhash64("vec_id"), F.col(m)).cast("int")
    train = rows.where("split = 'train'").withColumn("tb", own("n_train")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_test") - 1)))
    test = rows.where("split <> 'train'").withColumn("qb", own("n_test")).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("n_train") - 1)))

    def work(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "machine": np.zeros(0, object), "machine_id": np.zeros(0, object), "y": np.zeros(0, np.int32), "d": np.zeros(0, object)})
        d = nearest(np.vstack(q["v"].to_numpy()), np.vstack(t["v"].to_numpy()), k)
        return pd.DataFrame({"vec_id": q["vec_id"], "machine": q["machine"], "machine_id": q["machine_id"], "y": (q["split"] == "test_abnormal").astype("int32"), "d": list(d)})

    by = [*KEYS, "qb", "tb"]
    train = train.select(*[F.col(c).alias(c) for c in train.columns])
    near = test.groupBy(*by).cogroup(train.groupBy(*by)).applyInPandas(work, "vec_id long, machine string, machine_id string, y int, d array<double>")
    best = near.groupBy("vec_id", *KEYS, "y").agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("d"))
    return best.select("vec_id", *KEYS, "y", (F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d")).alias("score"))


def shrinkage(x: np.ndarray) -> tuple[float, float]:
    """Ledoit-Wolf weight of the scaled identity, and that scale, from the rows' Gram matrix alone."""
    n, p = x.shape
    c = x - x.mean(axis=0)
    gram = c @ c.T
    trace = np.trace(gram) / n
    mu = trace / p
    delta_ = (gram**2).sum() / n**2
    beta = ((np.diag(gram) ** 2).sum() / n - delta_) / (p * n)
    delta = (delta_ - 2 * mu * trace + p * mu**2) / p
    beta = min(beta, delta)
    return (0.0 if beta == 0 else beta / delta), mu


def mahalanobis(train: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Distances under the shrunk covariance; for more columns than rows by the Woodbury identity."""
    if len(train) < 2:
        raise ValueError("a covariance needs two rows or more")
    s, mu = shrinkage(train)
    n, p = train.shape
    mean = train.mean(axis=0)
    c, z = train - mean, test - mean
    a = s * mu
    if a > 0 and p > n:
        inner = np.eye(n) * a + (1 - s) / n * (c @ c.T)
        cz = z @ c.T
        squared = ((z**2).sum(axis=1) - (1 - s) / n * (cz * np.linalg.solve(inner, cz.T).T).sum(axis=1)) / a
    else:
        squared = (z * np.linalg.lstsq((1 - s) / n * (c.T @ c) + a * np.eye(p), z.T, rcond=None)[0].T).sum(axis=1)
    return np.sqrt(np.maximum(squared, 0))


def mahalanobis_scores(split: DataFrame, block: int = 4096, strict: bool = False) -> DataFrame:
    """The covariance scorer per id: its moments, merged by blocks, meet blocks of its test rows.

    Ids with fewer than two train rows have no covariance: their test rows are left out, or an error if ``strict``.
    """
    test = split.where("split <> 'train'").select("vec_id", *KEYS, (F.col("split") == "test_abnormal").cast("int").alias("y"), "v")
    blocks = test.groupBy(*KEYS).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    known = blocks.join(moments.moments(split.where("split = 'train'"), KEYS), KEYS, "left")
    if strict:
        known = known.withColumn("n", F.when(F.coalesce("n", F.lit(0)) < 2, F.raise_error(F.lit("a covariance needs two train rows or more"))).otherwise(F.col("n")))
    spread = known.where("n >= 2").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*KEYS, "qb", "block", "sums")
    rows = test.join(blocks, KEYS).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")

    def work(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if q.empty or m.empty:
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "machine": np.zeros(0, object), "machine_id": np.zeros(0, object), "y": np.zeros(0, np.int32), "score": np.zeros(0)})
        model = moments.assembled(m["sums"])
        s, mu = model.shrinkage()
        cov = (1 - s) / model.n * model.products + s * mu * np.eye(len(model.mean))
        z = np.vstack(q["v"].to_numpy()) - model.mean
        solved = np.linalg.solve(cov, z.T) if s * mu > 0 else np.linalg.lstsq(cov, z.T, rcond=None)[0]
        return pd.DataFrame({"vec_id": q["vec_id"], "machine": q["machine"], "machine_id": q["machine_id"], "y": q["y"], "score": np.sqrt(np.maximum((z * solved.T).sum(axis=1), 0))})

    by = [*KEYS, "qb"]
    spread = spread.select(*[F.col(c).alias(c) for c in spread.columns])
    return rows.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(work, "vec_id long, machine string, machine_id string, y int, score double")


def lw_shrinkage(train: DataFrame) -> DataFrame:
    """keys, n, shrinkage of each id's train vectors."""

    def work(m: pd.DataFrame) -> pd.DataFrame:
        model = moments.assembled(m["sums"])
        return pd.DataFrame({**{k: [m[k].iloc[0]] for k in KEYS}, "n": [model.n], "shrinkage": [round(model.shrinkage()[0], 6)]})

    return moments.moments(train, KEYS).groupBy(*KEYS).applyInPandas(work, "machine string, machine_id string, n long, shrinkage double")


def mean_scores(split: DataFrame) -> DataFrame:
    """vec_id, keys, y, score: cosine distance to the mean of the id's train vectors; all in the JVM, one small row for each id.

    The means are written: Spark then knows their size and takes small ones to the rows, which stay where they are.
    """
    mean = written(mean_vector(split.where("split = 'train'"), KEYS).withColumn("mean", unit(F.col("mean"))), "means")
    rows = split.where("split <> 'train'").join(mean, KEYS)
    return rows.select("vec_id", *KEYS, (F.col("split") == "test_abnormal").cast("int").alias("y"), cosine_distance(unit(F.col("v")), F.col("mean")).alias("score"))


def moment_figures(train: DataFrame) -> DataFrame:
    """keys, n, trace, fourth, spread: what the shrinkage is made of, for each id."""

    def work(m: pd.DataFrame) -> pd.DataFrame:
        model = moments.assembled(m["sums"])
        return pd.DataFrame({**{k: [m[k].iloc[0]] for k in KEYS}, "n": [model.n], "trace": [round(float(np.trace(model.products)), 6)], "fourth": [round(model.fourth, 6)], "spread": [round(float((model.products**2).sum()), 4)]})

    return moments.moments(train, KEYS).groupBy(*KEYS).applyInPandas(work, "machine string, machine_id string, n long, trace double, fourth double, spread double")


#: Named scorers that run side by side; each maps split clips to (vec_id, machine, machine_id, y, score).
SCORERS: dict[str, Callable[[DataFrame], DataFrame]] = {"knn": knn_scores_blocked, "mahalanobis": mahalanobis_scores}


def all_scores(split: DataFrame, scorers: dict | None = None) -> DataFrame:
    out = None
    for name, score in (scorers or SCORERS).items():
        one = score(split).withColumn("scorer", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
