"""Exact nearest neighbours within keys, by cells that the triangle inequality rules out.

The train rows of a key are cut into hash blocks of about ``TRAIN_BLOCK`` rows (at most ``VALUES`` numbers), each packed into one
row and sorted into cells around pivots of its own, with their radii.  A block of queries meets each of these once: in the task a
query visits the nearest cells that hold k rows, and then every cell that could hold something as near as the k-th so far.
Vectors travel as often as the other side has blocks, which are few, large and independent of the cells: a key's queries are cut into
``PARTS`` blocks at most until these hold ``QUERY_WIDE`` rows.  No row is made for a pair, and no task holds a key.

Distances are 1 - cosine; unit vectors a distance d apart are sqrt(2 d) apart in space, where the inequality holds.  Zero vectors are at
distance 1 from everything and have a cell of their own.  Distances equal to 12 places are ties and go by train id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

PIVOTS, TRAIN_BLOCK, QUERY_BLOCK, QUERY_WIDE = 32, 32768, 1024, 16384
#: Most query blocks of a key as long as they are not wide: enough for all cores, few enough copies of the train rows.
PARTS = 4
#: Numbers in a packed block, and distances that a task holds at once.
VALUES = 1 << 21
ZERO = -1
PLACES = 12


def units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def parts(n: Column, least: int, most: int, wide: Column | int) -> Column:
    """Blocks for n rows: of ``least`` rows while they are no more than ``most``, which grow until they hold ``wide`` rows."""
    return F.greatest(F.lit(1), F.least(F.ceil(n / least), F.lit(most)), F.ceil(n / wide)).cast("int")


def spread(rows: DataFrame, keys: list[str], row_id: str, n_blocks: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """rows with ``name``, the hash block that each is in, and the number of blocks of each key (``n_blocks`` aggregates its rows)."""
    counts = rows.groupBy(*keys).agg(n_blocks.alias(f"n_{name}"))
    return rows.join(counts, keys).withColumn(name, F.pmod(F.xxhash64(row_id), F.col(f"n_{name}")).cast("int")).drop(f"n_{name}"), counts


def dealt(rows: DataFrame, counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A copy of each row for every block of its key."""
    out = rows.join(counts, keys).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(f"n_{name}") - 1))).drop(f"n_{name}")
    return out.select(*[F.col(c).alias(c) for c in out.columns])


class Best:
    """The k smallest (d, id) so far of each of some queries."""

    def __init__(self, n: int, k: int, kind: np.dtype):
        self.k, self.d, self.ids, self.n = k, np.full((n, k), 3.0), np.zeros((n, k), kind), np.zeros(n, int)

    def meet(self, rows: np.ndarray, q: np.ndarray, t: np.ndarray, ids: np.ndarray) -> None:
        """Queries ``q``, whose places are ``rows``, against all of ``t``."""
        near = q @ t.T
        least, k = 1 - self.d[rows, -1], self.k
        if len(ids) > k and (self.n[rows] < k).any():
            least = np.maximum(least, np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k])
        # what rounds to the k-th distance is a tie and stays in
        i, j = np.nonzero(near >= least[:, None] - 2 * 10.0**-PLACES)
        d, r = np.round(np.clip(1 - near[i, j], 0, 2), PLACES), rows[i]
        better = (self.n[r] < k) | (d < self.d[r, -1]) | ((d == self.d[r, -1]) & (ids[j] < self.ids[r, -1]))
        r, d, own = r[better], d[better], ids[j[better]]
        if not len(r):
            return
        touched = np.unique(r)
        held = np.arange(k) < self.n[touched][:, None]
        at = np.concatenate([r, np.repeat(touched, self.n[touched])])
        d, own = np.concatenate([d, self.d[touched][held]]), np.concatenate([own, self.ids[touched][held]])
        order = np.lexsort((own, d, at))
        at, d, own = at[order], d[order], own[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        first = rank < k
        self.d[at[first], rank[first]], self.ids[at[first], rank[first]] = d[first], own[first]
        self.n[touched] = np.minimum(k, np.bincount(np.searchsorted(touched, at)))


class Neighbours:
    """The packed blocks of train(keys, t_id, v), written once, for any number of searches.

    ``blocks`` has a row for each cell; after a search ``chosen`` has one for each cell that was visited, with its queries.
    """

    def __init__(self, train: DataFrame, keys: list[str], t_id: str, vector: str = "v", pivots: int = PIVOTS):
        self.keys, self.kinds = keys, ", ".join(f"{k} {train.schema[k].dataType.simpleString()}" for k in keys)
        self.id_kind = train.schema[t_id].dataType.simpleString()
        rows = written(train.select(*keys, F.col(t_id).alias("t_id"), F.col(vector).cast("array<double>").alias("v")), "train")
        most = F.least(F.lit(TRAIN_BLOCK), F.greatest(F.lit(1), F.floor(VALUES / F.greatest(F.lit(1), F.max(F.size("v"))))))
        own, self.counts = spread(rows, keys, "t_id", F.ceil(F.count(F.lit(1)) / most).cast("int"), "hb")

        def pack(t: pd.DataFrame) -> pd.DataFrame:
            t = t.sort_values("t_id")
            u, ids = units(np.vstack(t["v"].to_numpy())), t["t_id"].to_numpy()
            some = np.flatnonzero(u.any(axis=1))
            cells, far = np.full(len(u), ZERO), np.zeros(len(u))
            centre = u[np.sort(np.random.default_rng(0).choice(some, min(pivots, len(some)), replace=False))] if len(some) else u[:0]
            if len(some):
                near = u[some] @ centre.T
                cells[some] = near.argmax(axis=1)
                far[some] = np.linalg.norm(u[some] - centre[cells[some]], axis=1)
            order = np.argsort(cells, kind="stable")
            made = [{"cell": int(c), "n": int((cells == c).sum()), "radius": float(far[cells == c].max()), "pivot": centre[c].tolist() if c != ZERO else [0.0] * u.shape[1]} for c in np.unique(cells)]
            return pd.DataFrame([(*(t[k].iloc[0] for k in keys), int(t["hb"].iloc[0]), made, ids[order].tolist(), u[order].tobytes())], columns=[*keys, "hb", "cells", "ids", "u"])

        shape = f"{self.kinds}, hb int, cells array<struct<cell:int,n:int,radius:double,pivot:array<double>>>, ids array<{self.id_kind}>, u binary"
        self.packed = written(own.groupBy(*keys, "hb").applyInPandas(pack, shape), "blocks")
        self.blocks = self.packed.select(*keys, "hb", F.inline("cells"))

    def met(self, queries: DataFrame, n_queries: DataFrame, k: int) -> DataFrame:
        """keys, hb, q_id, near, visited of queries(keys, qb, q_id, v): the k nearest (d, t_id) in each packed block, and the cells that were visited."""
        keys, kind = self.keys, queries.schema["q_id"].dataType.simpleString()
        names = [*keys, "hb", "q_id", "near", "visited"]

        def search(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            if q.empty or t.empty:
                return pd.DataFrame([], columns=names)
            u, ids, cells = np.frombuffer(t["u"].iloc[0]).reshape(len(t["ids"].iloc[0]), -1), np.asarray(t["ids"].iloc[0]), t["cells"].iloc[0]
            n, radius = np.array([c["n"] for c in cells]), np.array([c["radius"] for c in cells])
            ends = np.cumsum(n)
            zero, centre = np.array([c["cell"] == ZERO for c in cells]), np.vstack([c["pivot"] for c in cells])
            at = [c["cell"] for c in cells]
            x, near, visited = units(np.vstack(q["v"].to_numpy())), [], []
            stripe = max(1, VALUES // int(n.max()))
            for lo in range(0, len(x), stripe):
                y = x[lo : lo + stripe]
                gap = np.sqrt(np.maximum(0, 2 - 2 * np.clip(y @ centre.T, -1, 1)))
                least = np.maximum(0, gap - radius - 1e-7) ** 2 / 2
                # a zero vector is at distance 1, as query or in its own cell
                least[:, zero] = 1.0
                least[~y.any(axis=1)] = 1.0
                order = np.argsort(least, axis=1, kind="stable")
                first = np.zeros(least.shape, bool)
                np.put_along_axis(first, order, np.cumsum(n[order], axis=1) - n[order] < k, axis=1)
                best, went = Best(len(y), k, ids.dtype), first.copy()
                for again in (False, True):
                    for j in range(len(n)):
                        go = ~first[:, j] & (least[:, j] <= best.d[:, -1] + 1e-9) if again else first[:, j]
                        if go.any():
                            went[:, j] |= go
                            rows, a, z = np.flatnonzero(go), ends[j] - n[j], ends[j]
                            best.meet(rows, y[rows], u[a:z], ids[a:z])
                near += [[{"d": d, "t_id": i} for d, i in zip(ds[:m], own[:m])] for ds, own, m in zip(best.d.tolist(), best.ids.tolist(), best.n.tolist())]
                visited += [[at[j] for j in np.flatnonzero(w)] for w in went]
            return pd.DataFrame({**{c: [q[c].iloc[0]] * len(q) for c in keys}, "hb": t["hb"].iloc[0], "q_id": q["q_id"], "near": near, "visited": visited})

        by = [*keys, "qb", "hb"]
        mine = dealt(queries, self.counts, keys, "hb").groupBy(*by)
        return mine.cogroup(dealt(self.packed, n_queries, keys, "qb").groupBy(*by)).applyInPandas(search, f"{self.kinds}, hb int, q_id {kind}, near array<struct<d:double,t_id:{self.id_kind}>>, visited array<int>")

    def search(self, queries: DataFrame, q_id: str, k: int, vector: str = "v") -> DataFrame:
        """keys, q_id, near: the k nearest (d, t_id) of each of queries(keys, q_id, v), nearest first; fewer if the key has fewer."""
        keys = self.keys
        rows = written(queries.select(*keys, F.col(q_id).alias("q_id"), F.col(vector).cast("array<double>").alias("v")), "queries")
        own, counts = spread(rows, keys, "q_id", parts(F.count(F.lit(1)), QUERY_BLOCK, PARTS, QUERY_WIDE), "qb")
        met = self.met(own, counts, k)
        self.chosen = met.select(*keys, "hb", "q_id", F.explode("visited").alias("cell")).groupBy(*keys, "hb", "cell").agg(F.collect_list("q_id").alias("q_ids"))
        best = met.groupBy(*keys, "q_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
        return best.select(*keys, F.col("q_id").alias(q_id), "near")
