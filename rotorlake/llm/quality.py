"""Operator 2: quality rules whose thresholds carry a guarantee.

Each rule compares one figure of a document with a cutoff.  Cutoffs come from labelled documents.  Per stratum
(language) the rules advance side by side from their laxest cutoffs on, along one fixed sequence of joint settings
(``joint_walk``); a setting is certified while the exact (Clopper-Pearson) upper bound of the share of good documents that any
rule rejects stays within the limit, and the walk stops at the first that is not (fixed-sequence testing, so the walk itself
needs no further correction).  The error probability is split over the strata (Bonferroni), so that with probability
``1 - delta`` at most ``limit`` of the good documents of every stratum are rejected.  A stratum with too few labels certifies
nothing and keeps its documents.  The query and the pipeline use ``joint_thresholds``; ``thresholds`` gives the same promise with a walk for
each rule, splitting limit and error over the rules, and needs more labels.

Null and empty texts have no words and fail the base test; texts of any length are measured whole; null languages form a
stratum of their own, apart from the empty one; a figure equal to a cutoff (a tie) is not rejected; repeated rows are judged
one by one; repeated labels of one id count once (the smallest wins); empty tables give none; extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, read, text_batches
from .textkernels import NON_SPACE, mix as mix64, owners, shingle_hashes, span_hashes, texts

#: Figure and cutoffs (laxest first); a document is rejected if the figure is above the cutoff.
RULES = {
    "symbols_per_100_words": (300, 200, 150, 100, 75, 50, 40, 30, 25, 20, 15, 12, 10, 8, 6, 5),
    "bangs_per_100_words": (300, 200, 150, 100, 75, 50, 40, 30, 25, 20, 15, 12, 10, 8, 6, 5),
    "repeats_per_100_words": (80, 60, 50, 40, 35, 30, 25, 20, 18, 16, 14, 12, 10),
    "dup_lines_per_100_lines": (90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20),
    "upper_per_100_letters": (95, 90, 80, 70, 60, 50, 40, 30, 25, 20, 15),
}
LIMIT, DELTA = 0.02, 0.05

FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bangs long, n_upper long, n_letters long"

_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True


def _count(owner: np.ndarray, flags: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner[flags], minlength=n).astype(np.int64)


def figures(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """The figures of every text of a column, chunk by chunk."""
    for c in texts(column):
        starts, ends, first = c.words(NON_SPACE)
        n_words = np.diff(first)
        owner = owners(first, len(starts))
        out = {"n_words": n_words.astype(np.int64), "word_chars": c.per_text(NON_SPACE[c.data] & ~_CONT[c.data]), "n_symbols": c.per_text(_SYMBOL[c.data])}
        # lines with a word, equal to an earlier line of the text
        line = np.zeros(len(c.data) + 1, bool)
        line[c.offs] = True
        line[1:] |= c.data == 10
        l_starts = np.flatnonzero(line[:-1]) if len(c.data) else np.zeros(0, np.int64)
        l_ends = np.append(l_starts[1:], len(c.data)) if len(l_starts) else l_starts
        if len(l_starts):
            l_ends = l_ends - (c.data[l_ends - 1] == 10)
        l_owner = np.searchsorted(c.offs, l_starts, "right") - 1
        has_word = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
        h = span_hashes(c.data, l_starts, l_ends)[has_word] + mix64(l_owner[has_word].astype(np.uint64))
        l_owner = l_owner[has_word]
        order = np.argsort(h)
        out["n_dup_lines"] = _count(l_owner[order][1:], h[order][1:] == h[order][:-1], c.n)
        out["n_lines"] = np.bincount(l_owner, minlength=c.n).astype(np.int64)
        # words inside windows of five that the text has twice or more
        g, at = shingle_hashes(span_hashes(c.data, starts, ends), first, 5)
        g = g + mix64(owner[at].astype(np.uint64))
        order = np.argsort(g)
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(g), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        size = len(starts) + 1
        edge = np.bincount(at[twice], minlength=size) - np.bincount(at[twice] + 5, minlength=size)
        out["n_repeat_words"] = _count(owner, np.cumsum(edge)[:-1] > 0, c.n)
        out["n_bangs"], out["n_upper"], out["n_letters"] = (c.per_text(t[c.data]) for t in (_BANG, _UPPER, _LETTER))
        yield out


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), with_text: bool = False) -> DataFrame:
    """The columns named in ``keep`` and the figures of each row's text; the text itself only if asked for."""
    names = [x.split()[0] for x in FIGURES.split(", ")]
    text_batches(docs.sparkSession)
    keep = tuple(k for k in keep if with_text or k != "text")
    rows = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = list(figures(b.column("text")))
            new = [pa.array(np.concatenate([x[n] for x in chunks]) if chunks else np.zeros(0, np.int64)) for n in names]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *new], names=[*keep, *names])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[k] for k in keep), *(T.StructField(n, T.LongType()) for n in names)]))


def rule_figures() -> dict:
    """Each rule's figure as a column of the measured figures."""
    per = lambda a, b: F.col(a) * 100.0 / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_100_words": per("n_symbols", "n_words"),
        "bangs_per_100_words": per("n_bangs", "n_words"),
        "repeats_per_100_words": per("n_repeat_words", "n_words"),
        "dup_lines_per_100_lines": per("n_dup_lines", "n_lines"),
        "upper_per_100_letters": per("n_upper", "n_letters"),
    }


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with chance p, summed exactly term by term."""
    if k >= n:
        return 1.0
    log_p, log_q, top = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q) for i in range(k + 1)))


def certified(n: int, rejected: list[int], limit: float, delta: float) -> int:
    """How many of the cutoffs, from the laxest on, are certified.

    The upper Clopper-Pearson bound is within the limit exactly if P(X <= k | n, limit) <= delta.
    """
    for i, k in enumerate(rejected):
        if n == 0 or binomial_tail(k, n, limit) > delta:
            return i
    return len(rejected)


def thresholds(measured: DataFrame, good_ids: DataFrame, limit: float = LIMIT, delta: float = DELTA, rules=RULES) -> DataFrame:
    """stratum, n_good and one certified cutoff per rule (null: none) from the good labelled documents.

    Counts are one aggregation over all labelled rows; only one row per stratum reaches Python.
    """
    figs = rule_figures()
    good = measured.join(good_ids, "doc_id").where(~base_failed())
    counts = good.groupBy(F.col("lang").alias("stratum")).agg(
        F.count(F.lit(1)).alias("n_good"),
        *[F.array(*[F.sum((figs[r] > c).cast("long")) for c in cuts]).alias(r) for r, cuts in rules.items()],
    )
    counts = materialise(counts, "counts")
    n_strata = max(1, counts.count())
    share, each = limit / len(rules), delta / (n_strata * len(rules))

    def certify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["stratum", "n_good"]].copy()
            for r, cuts in rules.items():
                last = [certified(int(n), [int(k) for k in ks], share, each) for n, ks in zip(pdf["n_good"], pdf[r])]
                out[r] = [float(cuts[i - 1]) if i else None for i in last]
            yield out

    return counts.mapInPandas(certify, "stratum string, n_good long, " + ", ".join(f"{r} double" for r in rules))


def joint_walk(rules=RULES) -> list[tuple[str, float]]:
    """The order in which cutoffs join the setting, all rules advancing side by side from the laxest on."""
    steps = [((i + 1) / len(cuts), k, r, c) for k, (r, cuts) in enumerate(rules.items()) for i, c in enumerate(cuts)]
    return [(r, c) for _, _, r, c in sorted(steps)]


def joint_thresholds(measured: DataFrame, good_ids: DataFrame, limit: float = LIMIT, delta: float = DELTA, rules=RULES) -> DataFrame:
    """The columns of ``thresholds``; what is certified is the share of good documents that any rule rejects.

    The settings of a stratum are one fixed sequence, tested until the first that fails, so only the strata
    share ``delta``.  Without false rejections about 220 good labels certify a setting in one of four strata.
    """
    figs, walk = rule_figures(), joint_walk(rules)
    first = []  # step at which a rule begins to reject the row
    for r in rules:
        at = F.lit(len(walk))
        for k, c in reversed([(k, c) for k, (x, c) in enumerate(walk) if x == r]):
            at = F.when(figs[r] > c, F.lit(k)).otherwise(at)
        first.append(at)
    good = measured.join(good_ids, "doc_id").where(~base_failed())
    counts = good.select(F.col("lang").alias("stratum"), F.least(*first, F.lit(len(walk))).alias("step")).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_good"), F.array(*[F.count_if(F.col("step") <= k) for k in range(len(walk))]).alias("rejected")
    )
    counts = materialise(counts, "counts")
    each = delta / max(1, counts.count())

    def certify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["stratum", "n_good"]].copy()
            cut = [dict(walk[: certified(int(n), [int(k) for k in ks], limit, each)]) for n, ks in zip(pdf["n_good"], pdf["rejected"])]
            for r in rules:
                out[r] = [float(c[r]) if r in c else None for c in cut]
            yield out

    return counts.mapInPandas(certify, "stratum string, n_good long, " + ", ".join(f"{r} double" for r in rules))


def judge(measured: DataFrame, cutoffs: DataFrame, rules=RULES) -> DataFrame:
    """Adds base_failed, rejected_by (the rules that reject) and kept."""
    figs = rule_figures()
    cut = cutoffs.select(F.col("stratum").alias("c_stratum"), *[F.col(r).alias(f"c_{r}") for r in rules])
    hits = F.filter(F.array(*[F.when(figs[r] > F.col(f"c_{r}"), F.lit(r)) for r in rules]), lambda x: x.isNotNull())
    return (
        measured.join(cut, F.col("lang").eqNullSafe(F.col("c_stratum")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", F.array_join(hits, ","))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
        .drop("c_stratum", *[f"c_{r}" for r in rules])
    )


def filter_documents(docs: DataFrame, cutoffs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that are kept; figures are made again beside each text, so that no text is shuffled."""
    measured = measure(docs, tuple(docs.columns), with_text=True)
    return judge(measured, cutoffs, rules).where("kept").select(*docs.columns)


def good_documents(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialise(measure(read(spark, sf_dir, "documents")), "figures")
    cutoffs = materialise(joint_thresholds(measured, good_documents(read(spark, sf_dir, "labels"))), "cutoffs")
    return judge(measured, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def _sql() -> str:
    figs = {"symbols_per_100_words": ("n_symbols", "n_words"), "bangs_per_100_words": ("n_bangs", "n_words"), "repeats_per_100_words": ("n_repeat_words", "n_words"), "dup_lines_per_100_lines": ("n_dup_lines", "n_lines"), "upper_per_100_letters": ("n_upper", "n_letters")}
    pairs = ", ".join(f"{{'r': '{r}', 'o': {k}, 'x': {a} * 100.0::DOUBLE / greatest({b}, 1)}}" for k, (r, (a, b)) in enumerate(figs.items()))
    walk = ", ".join(f"({k}, '{r}', {c})" for k, (r, c) in enumerate(joint_walk()))
    return f"""
WITH w AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines, len(regexp_extract_all(t, '[!?]')) AS n_bangs, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT doc_id, stratum, base_failed, unnest([{pairs}], recursive := true) FROM b),
walk AS (SELECT * FROM (VALUES {walk}) AS v(k, r, cut)),
good AS (SELECT f.* FROM f JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) g ON f.doc_id = g.doc_id WHERE NOT base_failed),
step AS (SELECT good.doc_id, stratum, min(k) AS first FROM good LEFT JOIN walk ON good.r = walk.r AND x > cut GROUP BY good.doc_id, stratum),
size AS (SELECT stratum, count(*) AS n FROM step GROUP BY stratum),
bad AS (SELECT size.stratum, any_value(n) AS n, walk.k AS place, count(first) FILTER (first <= walk.k) AS k FROM size JOIN step ON size.stratum IS NOT DISTINCT FROM step.stratum, walk GROUP BY size.stratum, walk.k),
tail AS (SELECT *, CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({LIMIT}::DOUBLE) + (n - j) * ln(1 - {LIMIT}::DOUBLE)))) END AS p FROM bad),
sure AS (SELECT stratum, place FROM (SELECT *, bool_and(p <= {DELTA}::DOUBLE / (SELECT count(*) FROM size)) OVER (PARTITION BY stratum ORDER BY place ROWS UNBOUNDED PRECEDING) AS walked FROM tail) WHERE walked),
cut AS (SELECT stratum, r, min(cut) AS cut FROM sure JOIN walk ON sure.place = walk.k GROUP BY stratum, r),
hit AS (SELECT doc_id, string_agg(f.r, ',' ORDER BY o) AS rejected_by FROM f JOIN cut ON f.stratum IS NOT DISTINCT FROM cut.stratum AND f.r = cut.r WHERE x > cut GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM b LEFT JOIN hit ON b.doc_id = hit.doc_id
"""


OP2_SQL = _sql()
