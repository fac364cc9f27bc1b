"""Feature jobs: named embedders and feature kinds run over samples, model state once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import dsp

#: Feature kinds: samples to a vector.  ``register`` adds more.
KINDS: dict[str, Callable[[], Callable[[np.ndarray], np.ndarray]]] = {}


def register(name: str, make: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> None:
    """Adds a kind; ``make`` is called once per task and may load a model there."""
    KINDS[name] = make


def _logmel_mean() -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: dsp.logmel(x).mean(axis=1)


def _pooled() -> Callable[[np.ndarray], np.ndarray]:
    def embed(x: np.ndarray) -> np.ndarray:
        m = dsp.logmel(x)
        return np.concatenate([m.mean(axis=1), m.std(axis=1)])

    return embed


register("logmel", _logmel_mean)
register("pooled", _pooled)


def onnx_embedder(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A kind that runs an ONNX model on one thread; the session is made once per task."""

    def make():
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(path, options)
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x[None].astype(np.float32)})[0][0]

    return make


def features(rows: DataFrame, kind: str, column: str = "samples", out: str = "embedding") -> DataFrame:
    """Replaces samples by a vector of a kind; a narrow job, so nothing is shuffled.  Unknown kinds are an error."""
    if kind not in KINDS:
        raise KeyError(f"no feature kind named {kind}; there are {sorted(KINDS)}")
    make = KINDS[kind]
    keep = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make()
        for b in batches:
            column_ = b.column(column)
            vectors = [None if not column_[i].is_valid else np.asarray(embed(np.asarray(column_[i].values)), np.float32) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(vectors, pa.list_(pa.float32()))], names=[*keep, out])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + f", {out} array<float>"
    return rows.select(*keep, column).mapInArrow(run, schema)


def clip_windows(rows: DataFrame, size: int, hop: int, column: str = "samples") -> DataFrame:
    """One row per full window of each row's samples: window_no, and samples cut to it, in the JVM."""
    n = (F.floor((F.size(column) - size) / hop) + 1).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    keep = [c for c in rows.columns if c != column]
    cut = rows.withColumn("window_no", F.explode(starts))
    return cut.select(*keep, "window_no", F.slice(column, F.col("window_no") * hop + 1, size).alias(column))


@udtf(returnType="window_no int, samples array<float>")
class SliceWindows:
    """The same as a table function, for SQL: ``LATERAL slice_windows(samples, size, hop)``."""

    def eval(self, samples, size: int, hop: int):
        for k, a in enumerate(range(0, len(samples or []) - size + 1, hop)):
            yield k, samples[a : a + size]


def register_sql(spark) -> None:
    """Makes the helpers known to SQL: slice_windows (table function) and logmel_mean (vectorised function)."""
    spark.udtf.register("slice_windows", SliceWindows)

    @F.pandas_udf("array<float>")
    def logmel_mean(s):
        return s.map(lambda x: dsp.logmel(np.asarray(x)).mean(axis=1))

    spark.udf.register("logmel_mean", logmel_mean)


def envelope_peaks(rows: DataFrame, id_column: str, column: str = "samples") -> DataFrame:
    """id, freq_hz, prominence of the strongest envelope peaks of each row's samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k.as_py(), *p) for k, x in zip(b.column(0), b.column(1)) for p in dsp.envelope_peaks(np.asarray(x.values, float))]
            cols = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], names=["vec_id", "freq_hz", "prominence"])

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.where(F.col(column).isNotNull()).select(id_column, column).mapInArrow(run, f"vec_id {kind}, freq_hz double, prominence double")


def align_clips(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """rec, idx, lag, peak for pairs(rec, idx, block array<float>, clip array<float>), each a clip and the block around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r.as_py(), i.as_py(), *dsp.align(np.asarray(x.values, float), np.asarray(y.values, float))) for r, i, x, y in zip(*(b.column(n) for n in ("rec", "idx", "block", "clip")))]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["rec", "idx", "lag", "peak"])

    return pairs.select(F.col("rec").cast("string").alias("rec"), F.col("idx").cast("long").alias("idx"), "block", "clip").mapInArrow(run, "rec string, idx long, lag long, peak double").where(F.col("peak") >= least)
