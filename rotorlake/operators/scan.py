"""Scans over ordered rows whose keys may be hot: slices by range, a small prefix over slices, and the slices again.

A window or a fold by key has one task for each key, however long.  Here rows are dealt by ranges of (key, order), so a
long key is many slices; a slice is summed up without its past, the summaries of a key (one for each slice) are put
together in order, and each slice is run once more from the state that its past leaves.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.policy import ALERT, LISTENING, SUSPECT, AlertPolicy
from .tables import written


def in_slices(rows: DataFrame, keys: list[str], order: list, slices: int | None = None) -> DataFrame:
    """rows with slice, written once: ranges of (keys, order), as many as the session has shuffle partitions or ``slices``."""
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *keys, *order).withColumn("slice", F.spark_partition_id()), "slices")


def running_sums(rows: DataFrame, keys: list[str], order: list, values: list[str], slices: int | None = None) -> DataFrame:
    """rows with below_<v>, the sum over the key's rows before, and all_<v>, the key's sum, for each of ``values`` (whole numbers)."""
    own = in_slices(rows, keys, order, slices)
    sums = own.groupBy(*keys, "slice").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    by = W.partitionBy(*keys)
    past = by.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    known = sums.select(*[F.col(k).alias(f"k_{k}") for k in [*keys, "slice"]], *[F.coalesce(F.sum(f"t_{v}").over(past), F.lit(0)).alias(f"past_{v}") for v in values], *[F.sum(f"t_{v}").over(by).alias(f"all_{v}") for v in values])
    inner = W.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in [*keys, "slice"]]
    within = own.withColumns({f"in_{v}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for v in values})
    out = within.join(known, same)
    return out.select(*rows.columns, *[(F.col(f"in_{v}") + F.col(f"past_{v}")).alias(f"below_{v}") for v in values], *[f"all_{v}" for v in values])


# folds: summary and after put slices together; walk steps through the rows of one, stretches through many at once, run gives all its values

#: Arrow's names of the columns that folds make.
WIRE = {"double": pa.float64(), "long": pa.int64(), "string": pa.string()}


class Fold:
    def walk(self, state) -> Callable[..., tuple]:
        """A function from a row's inputs to its values, which carries the state along."""
        raise NotImplementedError

    def stretches(self, state) -> Callable[..., list]:
        """``walk`` for many rows at once: a function from lists of inputs to a list for each value."""
        step = self.walk(state)
        return lambda *inputs: [list(c) for c in zip(*map(step, *inputs))]

    def run(self, state, rows: list[tuple]) -> list[tuple]:
        step = self.walk(state)
        return [step(*row) for row in rows]


class Smooth(Fold):
    """EMA that starts at its first value; a slice is the affine map y -> a + b y."""

    inputs, schema = ["raw"], "ema double"

    def __init__(self, alpha: float = 0.3):
        self.alpha = alpha

    def start(self):
        return None

    def summary(self, raw: list[tuple]):
        a, b = 0.0, 1.0
        for (x,) in raw:
            a, b = self.alpha * x + (1 - self.alpha) * a, b * (1 - self.alpha)
        first = None
        for (x,) in raw:
            first = x if first is None else self.alpha * x + (1 - self.alpha) * first
        return a, b, first

    def after(self, state, summary):
        a, b, first = summary
        return first if state is None else a + b * state

    def walk(self, state):
        def step(x: float) -> tuple:
            nonlocal state
            state = x if state is None else self.alpha * x + (1 - self.alpha) * state
            return (state,)

        return step

    def stretches(self, state):
        def go(raw: list) -> list:
            nonlocal state
            y, a, b, out = state, self.alpha, 1 - self.alpha, []
            for x in raw:
                y = x if y is None else a * x + b * y
                out.append(y)
            state = y
            return [out]

        return go


class Streak(Fold):
    """How many hot rows end here; a slice is its length if all are hot, or the streak it ends with."""

    inputs, schema = ["percentile"], "streak long"

    def __init__(self, enter: float):
        self.enter = enter

    def start(self):
        return 0

    def summary(self, rows: list[tuple]):
        out = self.run(0, rows)
        return out[-1][0], out[-1][0] == len(rows)

    def after(self, state, summary):
        last, all_hot = summary
        return last + state if all_hot else last

    def walk(self, state):
        def step(p: float) -> tuple:
            nonlocal state
            state = state + 1 if p >= self.enter else 0
            return (state,)

        return step


class Alerts(Fold):
    """The alert policy; a slice is a table from each state that may come in to the state that goes out.

    What comes in is a state, a streak (beyond n all are alike) and the end of a cooldown, which matters only by the first row
    of the slice that is not before it; no cooldown reaches further than its length into the slice, and then it is none.
    Starts step as one from where they meet, mostly all after a few rows, so a table costs little more than a fold.
    """

    inputs, schema = ["percentile", "t"], "state string"

    def __init__(self, **policy):
        self.policy = policy
        self.n, self.cooldown = AlertPolicy(**policy).n, AlertPolicy(**policy).cooldown

    def start(self):
        return LISTENING, 0, 0.0, None

    def at(self, kind: str, streak: int, until: float, seen: float | None = None) -> AlertPolicy:
        a = AlertPolicy(**self.policy)
        a.state, a.streak, a.cooldown_until, a.last_t = kind, streak, until, seen
        return a

    def met(self, going: list, t: float) -> list:
        """``going`` with those that cannot differ any more as one; an inherited cooldown that is over by t is none."""
        out = {}
        for a, made, own in going:
            if not made and a.cooldown_until <= t:
                a.cooldown_until = -math.inf
            out.setdefault((a.state, min(a.streak, self.n), a.cooldown_until, made), [a, made, []])[2].extend(own)
        return list(out.values())

    def summary(self, rows: list[tuple]):
        first = rows[0][1]
        # -inf: over before the slice; inf: not over within it, which only slices are that end sooner
        reach = min((t for _, t in rows if t > first + self.cooldown), default=math.inf)
        ends = {t for _, t in rows if first < t <= reach}
        # a stream begins with a cooldown until 0, which is further off for times below it
        begun = min((t for _, t in rows if t >= 0), default=math.inf) if first < 0 else first
        ends = sorted(e for e in {*ends, begun} if first < e < math.inf)
        lasting = [math.inf] if math.inf in (reach, begun) else []
        starts = [(s, k, e) for e in (-math.inf, *ends, *lasting) for s, k in ((LISTENING, 0), *((SUSPECT, k) for k in range(1, self.n + 1)), *((ALERT, k) for k in range(self.n + 1)))]
        # a policy, whether it has set the end of the cooldown in this slice, and the starts that are there now
        going = [[self.at(*s), False, [s]] for s in starts]
        for p, t in rows:
            for one in going:
                a = one[0]
                was = a.state
                a.step(p, t)
                if was == ALERT != a.state:
                    one[1] = True
            if len(going) > 1:
                going = self.met(going, t)
        table = {s: (a.state, min(a.streak, self.n), a.cooldown_until if made else None) for a, made, own in going for s in own}
        return first, rows[-1][1], ends, table

    def after(self, state, summary):
        first, last, ends, table = summary
        kind, streak, until, seen = state
        if seen is not None and first < seen:
            raise ValueError(f"time went back from {seen} to {first}")
        end = -math.inf if until <= first else next((e for e in ends if e >= until), math.inf)
        if (kind, min(streak, self.n), end) not in table:
            raise ValueError(f"time went back to {first}: a cooldown lasts until {until}")
        kind, streak, made = table[kind, min(streak, self.n), end]
        return kind, streak, until if made is None else made, last

    def walk(self, state):
        a = self.at(*state)
        return lambda p, t: (a.step(p, t),)

    def stretches(self, state):
        a = self.at(*state)
        return lambda p, t: [list(map(a.step, p, t))]


def codes(c: pa.Array) -> np.ndarray:
    """A number for each value of a batch: equal ones are alike, and so are nulls, NaNs and both zeros, as Spark groups them."""
    plain = pc.add(c, pa.scalar(0.0, c.type)) if pa.types.is_floating(c.type) else c
    return plain.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def fold_in_slices(rows: DataFrame, key: str, order: list[str], fold, slices: int | None = None) -> DataFrame:
    """key, order columns and the fold's values, as a fold over each key's rows in order gives them.

    Keys are whole in a slice, but for those at its ends: at most one key for each boundary has its slices summed up.  Tasks
    then stream through sorted rows, any number of keys one after the other, with one state at a time.
    """
    names = list(dict.fromkeys([key, *order, *fold.inputs]))
    own = in_slices(rows.select(*names), [key], order, slices)
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    inputs = lambda pdf: list(pdf[fold.inputs].itertuples(index=False, name=None))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_no": pdf["_no"].iloc[:1], "slice": pdf["slice"].iloc[:1], "held": [pickle.dumps(fold.summary(inputs(pdf.sort_values(order, kind="stable"))))]})

    def begun(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = fold.start(), []
        pdf = pdf.sort_values("slice")
        for s in pdf["held"]:
            out.append(pickle.dumps(state))
            state = fold.after(state, pickle.loads(bytes(s)))
        return pdf.assign(held=out)

    kept = [key, *order]
    made = [x.split()[0] for x in fold.schema.split(", ")]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in dict.fromkeys(kept)), fold.schema])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = last = go = None
        for b in batches:
            if shape is None:
                shape = pa.schema([*(b.schema.field(c) for c in dict.fromkeys(kept)), *(pa.field(c, WIRE[x.split()[1]]) for c, x in zip(made, fold.schema.split(", ")))])
            if not b.num_rows:
                continue
            ids = [b.column(key), b.column("slice")]
            # rows that begin a stretch: another key or slice than the row before, which may be in the batch before
            seen = [pa.concat_arrays([old, c]) for old, c in zip(last, ids)] if last else ids
            other = np.flatnonzero(np.diff(codes(seen[0])) | np.diff(codes(seen[1])))
            fresh = set(other.tolist()) if last else {0, *(other + 1).tolist()}
            # through pandas: null numbers come as NaN, as they do in the summaries
            values = [b.column(c).to_pandas().tolist() for c in fold.inputs]
            columns, edges = [[] for _ in made], sorted({0, *fresh, b.num_rows})
            for i, j in zip(edges, edges[1:]):
                if i in fresh:
                    held = b.column("held")[i].as_py()
                    go = fold.stretches(fold.start() if held is None else pickle.loads(held))
                for column, own in zip(columns, go(*(v[i:j] for v in values))):
                    column.extend(own)
            last = [c.slice(b.num_rows - 1) for c in ids]
            yield pa.record_batch([*(b.column(c) for c in dict.fromkeys(kept)), *(pa.array(c, shape.field(m).type, from_pandas=True) for c, m in zip(columns, made))], schema=shape)

    small = "_no long, slice int, held binary"
    # as many keys as there are boundaries between slices, at most; written: what follows reads them twice.  Numbers stand for
    # the keys, as null and NaN are one to pandas.
    cut = own.groupBy(key).agg(F.min("slice").alias("a"), F.max("slice").alias("z")).where("a < z")
    cut = written(cut.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_no")), "cut")
    parts = own.join(F.broadcast(cut), F.col(key).eqNullSafe(F.col("_key"))).select("_no", "slice", *dict.fromkeys([*order, *fold.inputs]))
    starts = written(parts.groupBy("_no", "slice").applyInPandas(summed, small).groupBy("_no").applyInPandas(begun, small), "starts")
    known = F.broadcast(starts.join(F.broadcast(cut), "_no").select("_key", F.col("slice").alias("_slice"), "held"))
    begins = own.join(known, F.col(key).eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice")), "left").drop("_key", "_slice")
    return begins.repartition(key, "slice").sortWithinPartitions(key, "slice", *order).mapInArrow(finished, schema)
