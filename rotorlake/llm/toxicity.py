"""Operator 1: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of hashed features of its
words (the word, and its first four and six bytes); the document's score is their noisy-or,
``1 - prod(1 - sentence)``.  Only document labels are known; the weights that make the noisy-or fit them
also give each sentence its score, which locates the offending ones.

The likelihood of the document labels is maximised from weights of zero by a quasi-Newton method (limited-memory
BFGS over the noisy-or itself), in one task, on at most ``MAX_TRAIN`` labelled documents of at most ``MAX_BYTES``
together (the first by hash of each class, half of them of either), never on held-out ones (crc32 of the id mod
5 = 0); the model has ``2**BITS`` weights whatever the data, and is sent to the tasks that score every whole text.

Null and empty texts, and texts without words, have no sentences and score 0; very long texts are scored whole.
Sentences end at ``.!?`` and line ends; of sentences with equal scores the first is the worst.  Of several labels of
one id the largest counts, of several texts of one labelled id the smallest is learnt from.  Repeated rows are
scored one by one.  Without labels of both kinds every score is 0; an empty table gives none.  Labels, language,
source and id are not inputs of a score; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, read
from .textkernels import ALNUM, LOWER, mix, span_hashes, texts

BITS = 18
MAX_TRAIN, MAX_BYTES = 6000, 128 << 20
ITERATIONS, MEMORY, L2 = 100, 10, 1e-4
#: Training documents that must hold a feature for it to count, and the weight of all toxic documents together.  These and L2
#: were chosen on the documents of remainder 1, fitted on those of 2 to 4; the held-out ones (0) had no part in it.
MIN_DOCS, TOXIC_SHARE = 8, 0.8

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


def features(c) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (three a word), the sentence of each word, each text's first sentence, each sentence's first word."""
    data = LOWER[c.data]
    starts, ends, first = c.words(ALNUM, data)
    slots = np.empty((len(starts), 3), np.int64)
    for j, most in enumerate((1 << 30, 4, 6)):
        h = span_hashes(data, starts, np.minimum(ends, starts + most))
        slots[:, j] = (mix(h + np.uint64(j)) >> np.uint64(64 - BITS)).astype(np.int64)
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ENDS[data], out=breaks[1:])
    new = np.zeros(len(starts), bool)
    if len(starts):
        new[0] = True
        new[1:] = breaks[starts[1:]] != breaks[starts[:-1]]
        begin = first[:-1][np.diff(first) > 0]
        new[begin] = True
    s_first_word = np.flatnonzero(new)
    return slots, np.cumsum(new) - 1, np.searchsorted(s_first_word, first), s_first_word


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Bags:
    """Labelled bags of sentences and the loss of a noisy-or over them."""

    def __init__(self, slots: np.ndarray, sentence: np.ndarray, first_sentence: np.ndarray, y: np.ndarray):
        n = len(y)
        self.n, self.toxic = n, y == 1
        n_toxic = int(self.toxic.sum())
        self.doc = np.repeat(np.arange(n), np.diff(first_sentence))
        flat, owner = slots.reshape(-1).astype(np.int64), np.repeat(sentence, slots.shape[1])
        in_docs = np.bincount(np.unique(flat * n + self.doc[owner]) // n, minlength=1 << BITS)
        # few toxic documents lower MIN_DOCS
        self.used = np.flatnonzero(in_docs >= min(MIN_DOCS, 2 + n_toxic // 20))
        number = np.full(1 << BITS, -1)
        number[self.used] = np.arange(len(self.used))
        keep = number[flat] >= 0
        self.feature, self.owner = number[flat[keep]], owner[keep]
        self.weight = np.where(self.toxic, TOXIC_SHARE / max(1, n_toxic), (1 - TOXIC_SHARE) / max(1, n - n_toxic))

    def start(self) -> np.ndarray:
        """Weights of zero, and the bias that gives an average document its prior."""
        sentences = max(1.0, len(self.doc) / self.n)
        return np.append(np.zeros(len(self.used)), np.log(TOXIC_SHARE / 3 / sentences))

    def loss(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted negative log-likelihood with its L2 term, and the gradient; the last value of x is the bias."""
        p = sigmoid(x[-1] + np.bincount(self.owner, x[self.feature], len(self.doc)))
        log_none = np.bincount(self.doc, np.log1p(-p), self.n)
        none = np.exp(log_none)
        some = np.maximum(1 - none, 1e-12)
        value = -(self.weight * np.where(self.toxic, np.log(some), log_none)).sum() + L2 / 2 * (x[:-1] ** 2).sum()
        # d log-likelihood / d logit: -p for clean documents, p * none / (1 - none) for toxic ones
        g = p * (np.where(self.toxic, none / some, -1.0) * self.weight)[self.doc]
        return value, np.append(L2 * x[:-1] - np.bincount(self.feature, g[self.owner], len(self.used)), -g.sum())


def minimise(loss, x: np.ndarray, iterations: int = ITERATIONS, memory: int = MEMORY) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, g = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        step, parts = g.copy(), []
        for s, y in reversed(pairs):
            parts.append(s @ step / (s @ y))
            step -= parts[-1] * y
        step *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(pairs, reversed(parts)):
            step += s * (a - y @ step / (s @ y))
        t, slope = 1.0, g @ step
        while True:
            new_value, new_g = loss(x - t * step)
            if new_value <= value - 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        s, y = -t * step, new_g - g
        gain = value - new_value
        x, value, g = x + s, new_value, new_g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        if gain <= 1e-7 * abs(value):
            break
    return x


def fit(slots: np.ndarray, sentence: np.ndarray, first_sentence: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of noisy-or bags, from weights of zero."""
    w = np.zeros(1 << BITS, np.float32)
    if not len(slots) or int((y == 1).sum()) in (0, len(y)):
        return w, -30.0
    bags = Bags(slots, sentence, first_sentence, y)
    x = minimise(bags.loss, bags.start())
    w[bags.used] = x[:-1]
    return w, float(x[-1])


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, text, toxic of at most ``most`` labelled documents that are not held out; the same in every run."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    part = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
    sample = materialise(part(1).union(part(0)), "labelled")
    # one text per id, so that repeated ids bring no more rows
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ys, n_sent, n_bytes = [], [], 0, 0
        for b in batches:
            size = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0), np.int64)) + n_bytes
            b, n_bytes = b.slice(0, int(np.searchsorted(size, MAX_BYTES, "right"))), int(size[-1]) if len(size) else n_bytes
            ys.append(b.column("toxic").to_numpy())
            for c in texts(b.column("text")):
                slots, sentence, first, _ = features(c)
                parts.append((slots.astype(np.int32), sentence + n_sent, first[:-1] + n_sent))
                n_sent += int(first[-1])
        if not parts:
            return
        slots, sentence, first = (np.concatenate(x) for x in zip(*parts))
        w, bias = fit(slots, sentence, np.append(first, n_sent), np.concatenate(ys))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["w", "bias"])

    sample = training_sample(docs, labels, most)
    model = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", F.col("toxic").cast("int")).mapInArrow(run, "w binary, bias double").head()
    return (np.frombuffer(model[0], np.float32), model[1]) if model else (np.zeros(1 << BITS, np.float32), -30.0)


def score(docs: DataFrame, w: np.ndarray, bias: float, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score, n_sentences, n_offending (scores of 0.5 or more), worst_sentence (0-based), worst_score."""
    rows = docs.select(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(w)
    names = ["score", "n_sentences", "n_offending", "worst_sentence", "worst_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in names]
            for c in texts(b.column("text")):
                slots, sentence, first, _ = features(c)
                total = int(first[-1])
                p = sigmoid(bias + np.bincount(sentence, weights[slots].sum(axis=1), total)) if total else np.zeros(0)
                doc = np.repeat(np.arange(c.n), np.diff(first))
                some = np.flatnonzero(np.diff(first) > 0)
                worst, where = np.zeros(c.n), np.full(c.n, -1, np.int64)
                if len(some):
                    worst[some] = np.maximum.reduceat(p, first[some])
                    at = np.flatnonzero(p == worst[doc])[::-1]
                    where[doc[at]] = at - first[doc[at]]
                values = (1 - np.exp(np.bincount(doc, np.log1p(-p), c.n)), np.diff(first), np.bincount(doc, p >= 0.5, c.n).astype(np.int64), where, worst)
                for col, v in zip(cols, values):
                    col.append(v)
            new = [np.concatenate(x) if x else np.zeros(0) for x in cols]
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(x, t) for x, t in zip(new, kinds))], names=[*keep, *names])

    fields = [rows.schema[k] for k in keep] + [T.StructField(n, T.DoubleType() if n.endswith("score") else T.LongType()) for n in names]
    return rows.mapInArrow(run, T.StructType(fields))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    w, bias = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, w, bias).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        "n_offending",
        "worst_sentence",
        "worst_score",
    )
