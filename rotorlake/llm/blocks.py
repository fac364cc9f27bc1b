"""Groups of rows compared within themselves, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, group: str, n_blocks: Column, item: str) -> DataFrame:
    """Deals each group's rows into pairs of blocks, so that every pair of rows meets in exactly one.

    A group of one block stays as it is.  A row of a group of n blocks is copied n times, once for each block
    that its own is compared with.  Adds ``pair`` (which pair of blocks) and ``side`` (0 or 1; 0 only, within one block).
    """
    n = F.greatest(F.lit(1), n_blocks.cast("int"))
    own = F.pmod(F.xxhash64(item), n).cast("int")
    met = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.struct((F.least(k, own) * n + F.greatest(k, own)).cast("long").alias("pair"), (own > k).cast("int").alias("side"), (own == k).alias("alone")),
    )
    return rows.withColumn("met", F.explode(met)).select("*", "met.pair", "met.side", "met.alone").drop("met")


def far_blocks(rows: DataFrame, item: str) -> DataFrame:
    """Deals rows so that each pair meets in exactly one pair of blocks, but for pairs of two ``near`` rows.

    ``far_blocks`` and ``near_blocks`` say into how many blocks a group's rows of either kind go.  Adds ``pair``,
    ``side`` and ``alone`` as ``in_blocks`` does; pairs of a far and a near block have negative numbers.
    """
    far, near = F.col("far_blocks"), F.col("near_blocks")
    own = F.pmod(F.xxhash64(item), F.greatest(F.lit(1), F.when(F.col("near"), near).otherwise(far))).cast("long")
    shape = "array<struct<pair:long,side:int,alone:boolean>>"
    none = F.array().cast(shape)
    place = lambda pair, side, alone: F.struct(pair.cast("long").alias("pair"), side.cast("int").alias("side"), alone.alias("alone"))
    over = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)).otherwise(none)
    with_far = over(far, lambda k: place(F.least(k, own) * far + F.greatest(k, own), own > k, own == k))
    with_near = over(near, lambda k: place(-1 - (own * near + k), F.lit(0), F.lit(False)))
    from_near = over(far, lambda k: place(-1 - (k * near + own), F.lit(1), F.lit(False)))
    met = F.when(F.col("near"), from_near).otherwise(F.concat(with_far, with_near))
    return rows.withColumn("met", F.explode(met)).select("*", "met.pair", "met.side", "met.alone").drop("met")


def run_groups(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Calls ``work`` with stretches of whole groups (bounded batches sorted by the keys).

    ``keys`` must make groups of bounded size; they are streamed in sorted order, and never more than one
    batch and the group under way are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
            at = b.num_rows
            while at and tuple(b.column(k)[at - 1].as_py() for k in keys) == last:
                at -= 1
            if at or held and tuple(held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys) != last:
                whole = [*held, b.slice(0, at)] if at else held
                yield from work(whole)
                held = [b.slice(at)]
            else:
                held.append(b)
        if held:
            yield from work(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
