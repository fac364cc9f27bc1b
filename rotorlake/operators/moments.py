"""Count, mean, centred products and fourth norms of vectors by key, in one scan.

A task adds up its rows around a mean of their own; sums around two means become sums around their common one by
algebra, so nothing is read twice and no difference of large numbers is taken.  A key's p x p products travel as blocks of
rows, each with what it takes to move it, and are merged in two levels: no task holds more than a block of every task of
a group, and a key may have any number of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block's rows, bytes of sums that a task holds before it passes them on, groups of the first level.
BLOCK_BYTES, HELD_BYTES, GROUPS = 1 << 20, 256 << 20, 64


@dataclass
class Sums:
    """Sums over vectors y = x - centre: rows ``first`` onward of y y^T, those rows of |y|^2 y, and a share of |y|^4."""

    n: int
    centre: np.ndarray
    s1: np.ndarray
    trace: float
    first: int
    products: np.ndarray
    cubic: np.ndarray
    fourth: float

    def moved(self, centre: np.ndarray) -> Sums:
        d = centre - self.centre
        b = slice(self.first, self.first + len(self.products))
        size, along, turned = float(d @ d), float(self.s1 @ d), self.products @ d
        trace = self.trace - 2 * along + self.n * size
        fourth = self.fourth + 4 * float(d[b] @ turned) - 4 * float(self.cubic @ d[b])
        if not self.first:  # what belongs to no row is with the first block
            fourth += self.n * size * size + 2 * size * self.trace - 4 * size * along
        products = self.products - np.outer(self.s1[b], d) - np.outer(d[b], self.s1) + self.n * np.outer(d[b], d)
        return Sums(self.n, centre, self.s1 - self.n * d, trace, self.first, products, self.cubic - 2 * turned + size * self.s1[b] - d[b] * trace, fourth)

    def __add__(self, other: Sums) -> Sums:
        n = self.n + other.n
        centre = self.centre + (self.s1 + other.s1 + other.n * (other.centre - self.centre)) / n
        a, b = self.moved(centre), other.moved(centre)
        return Sums(n, centre, a.s1 + b.s1, a.trace + b.trace, a.first, a.products + b.products, a.cubic + b.cubic, a.fourth + b.fourth)


def sums_of(x: np.ndarray) -> Sums:
    """All rows of the products of vectors, around their mean."""
    centre = x.mean(axis=0)
    y = x - centre
    size = (y * y).sum(axis=1)
    return Sums(len(x), centre, y.sum(axis=0), float(size.sum()), 0, y.T @ y, y.T @ size, float((size * size).sum()))


def blocks_of(s: Sums) -> Iterator[Sums]:
    tall = max(1, BLOCK_BYTES // (8 * max(1, len(s.centre))))
    for k in range(0, max(1, len(s.products)), tall):
        yield Sums(s.n, s.centre, s.s1, s.trace, k, s.products[k : k + tall], s.cubic[k : k + tall], 0.0 if k else s.fourth)


@dataclass
class Model:
    """n, mean, sum of centred products, and sum of fourth powers of the distances from the mean."""

    n: int
    mean: np.ndarray
    products: np.ndarray
    fourth: float

    def shrinkage(self) -> tuple[float, float]:
        """Ledoit-Wolf weight of the scaled identity, and that scale."""
        n, p = self.n, len(self.mean)
        trace = float(np.trace(self.products)) / n
        mu = trace / p
        spread = float((self.products**2).sum()) / n**2
        delta = (spread - 2 * mu * trace + p * mu**2) / p
        beta = min((self.fourth / n - spread) / (p * n), delta)
        return (0.0 if beta == 0 else beta / delta), mu


def assembled(blocks: Iterable[bytes]) -> Model:
    """The model of a key's merged blocks; all are moved to the exact mean first."""
    parts = sorted((pickle.loads(bytes(b)) for b in blocks), key=lambda s: s.first)
    mean = parts[0].centre + parts[0].s1 / parts[0].n
    parts = [s.moved(mean) for s in parts]
    return Model(parts[0].n, mean, np.concatenate([s.products for s in parts]), sum(s.fourth for s in parts))


def moments(rows: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """keys, n, block, sums (a pickled ``Sums``) of rows(keys, vector); the blocks of a key make its ``Model``."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, task int, n long, block int, sums binary"

    def told(key: tuple, task: int, s: Sums) -> list[tuple]:
        return [(*key, task, b.n, b.first, pickle.dumps(b)) for b in blocks_of(s)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, held, size = TaskContext.get().partitionId(), {}, 0
        names = [*keys, "task", "n", "block", "sums"]
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False, dropna=False):
                s = sums_of(np.vstack(g[vector].to_numpy()).astype(np.float64))
                size += 0 if key in held else s.products.nbytes
                held[key] = held[key] + s if key in held else s
            if size > HELD_BYTES:
                yield pd.DataFrame([r for key, s in held.items() for r in told(key, task, s)], columns=names)
                held, size = {}, 0
        if held:
            yield pd.DataFrame([r for key, s in held.items() for r in told(key, task, s)], columns=names)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for b in pdf.sort_values("task", kind="stable")["sums"]:
            s = pickle.loads(bytes(b))
            total = s if total is None else total + s
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), int(pdf["task"].iloc[0]), total.n, total.first, pickle.dumps(total))], columns=[*keys, "task", "n", "block", "sums"])

    parts = rows.select(*keys, vector).mapInPandas(partial, schema)
    for by in ([*keys, "block", F.pmod("task", F.lit(GROUPS))], [*keys, "block"]):
        parts = parts.groupBy(*by).applyInPandas(merged, schema)
    return parts.drop("task")
