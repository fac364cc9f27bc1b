"""Operator 13: hard negatives by an inverted multi-index.

Both halves of the vectors get a codebook (k-means on at most ``MAX_SAMPLE`` rows); a vector's cell is its pair of nearest
code words.  Every row is in the index: blocks of at most about ``BLOCK`` rows of one cell, in a table bucketed by block, so that a hot
cell (a third of all rows may be copies) is many blocks and a search moves anchors, not the index.  A half score q.c + |q| r bounds
what a code word with radius r can add to an anchor's score; a heap walks the two sorted lists of half scores and
yields cells by falling sum.  Each search takes two turns.  The first visits the leading cells until they hold ``SEED_ROWS``
rows; their scores certify a lower bound for the last place wanted.  The second visits every cell whose bound reaches
that score and stops at the first sum below it, so no row that could take a place is left out.  The first search finds positives; the
second fills, for each distinct positive score, the window of negatives below it.  Cells whose own radii rule
them out are passed over.

Rows with a null id, label or vector, an empty vector, a null or non-finite entry, or another length than the commonest take
no part.  Whole entries beyond 2**26 in size stand for 2**26.  Rows of equal id are rows of their own: each is an anchor or candidate
by itself, ties going by id; equal vectors tie.  A positive score below zero has an empty window.  Anchors without a row of the
same label, positives without a negative, and an empty table give no rows.  Extra columns are never read.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, materialise, new_folder, read

SCALE, BOUND = 256, float(1 << 26)
WORDS, MAX_SAMPLE, TURNS = 16, 8192, 10
BLOCK, CHUNK, SLICE, SEED_ROWS = 4096, 1024, 256, 1024
ANCHORS, PLACES = 100, 5
LOWEST = -(1 << 62)

INDEX = "cell int, part int, ids binary, rids binary, labels binary, y binary"
VISITS = "cell int, part int, a_rids binary, a_labels binary, a_y binary, a_lows binary, a_tops binary"
FOUND = "a_rid long, top long, vec_id long, rid long, score long"


def whole_rows(vectors: DataFrame) -> DataFrame:
    """rid (row number), vec_id, label, y (array of whole numbers) of vectors(vec_id, embedding, label) that take part; written once."""
    c = F.col("embedding").cast("array<double>")
    good = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & c.isNotNull() & (F.size(c) > 0)).where(good)
    common = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    y = F.transform(c, lambda e: F.floor(F.least(F.greatest(e * SCALE, F.lit(-BOUND)), F.lit(BOUND))).cast("int"))
    rows = rows.where(F.size("embedding") == (common.width if common else 0))
    return materialise(rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), y.alias("y")), "rows")


def k_means(x: np.ndarray, words: int, turns: int = TURNS, seed: int = 13) -> np.ndarray:
    """At most ``words`` centres; starting points are spread by squared distance."""
    rng, x = np.random.default_rng(seed), np.unique(x, axis=0).astype(np.float64)
    centres = x[:1]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < words and far.max() > 0:
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    for _ in range(turns):
        near = nearest(x, centres)[0]
        centres = np.stack([x[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the distance to it, not below the true one."""
    near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(axis=1)) * (1 + 1e-12)


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole rows."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Codes:
    """Two codebooks with, for each cell, its rows and the radii of its halves; what all tasks of a search get (WORDS**2 cells)."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right, self.cut = left, right, left.shape[1]
        self.rows = np.zeros((len(left), len(right)), np.int64)
        self.radius = np.zeros((2, len(left), len(right)))

    def cells(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (a, ra), (b, rb) = nearest(y[:, : self.cut], self.left), nearest(y[:, self.cut :], self.right)
        return a * len(self.right) + b, ra, rb

    def parts(self, cell: int, block: int = BLOCK) -> int:
        return max(1, -(-int(self.rows.flat[cell]) // block))

    def walk(self, y: np.ndarray, floor: int, seed_rows: int | None) -> Iterator[int]:
        """Cells of one anchor by falling sum of half scores, down to ``floor`` or until ``seed_rows`` rows are met."""
        q = (y[: self.cut].astype(np.float64), y[self.cut :].astype(np.float64))
        size = [float(np.sqrt((h * h).sum())) for h in q]
        plain = [self.left @ q[0], self.right @ q[1]]
        sums = [plain[0] + size[0] * self.radius[0].max(axis=1), plain[1] + size[1] * self.radius[1].max(axis=0)]
        order = [np.argsort(-s, kind="stable") for s in sums]
        slack = 1e-9 * (1 + sum(float(np.abs(s).max()) for s in sums))
        u, v = (s[o].tolist() for s, o in zip(sums, order, strict=True))
        heap, seen, met = [(-(u[0] + v[0]), 0, 0)], {(0, 0)}, 0
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound + slack < floor or seed_rows is not None and met >= seed_rows:
                return
            a, b = int(order[0][i]), int(order[1][j])
            own = plain[0][a] + size[0] * self.radius[0, a, b] + plain[1][b] + size[1] * self.radius[1, a, b]
            if self.rows[a, b] and own + slack >= floor:
                met += int(self.rows[a, b])
                yield a * len(self.right) + b
            for k in ((i + 1, j), (i, j + 1)):
                if k[0] < len(u) and k[1] < len(v) and k not in seen:
                    seen.add(k)
                    heapq.heappush(heap, (-(u[k[0]] + v[k[1]]), *k))


class MultiIndex:
    """The codes and the bucketed table of blocks of all rows."""

    def __init__(self, rows: DataFrame, words: int = WORDS):
        spark = self.spark = rows.sparkSession
        n = rows.count()
        # about half of MAX_SAMPLE rows, told by hash; the limit only guards the driver
        share = min(1.0, MAX_SAMPLE / 2 / max(n, 1))
        sample = rows.where(F.pmod(F.xxhash64("vec_id", "rid"), F.lit(1 << 20)) < max(1, round(share * (1 << 20)))).limit(MAX_SAMPLE)
        y = np.array([r.y for r in sample.select("y").toLocalIterator()], np.int64)
        if not len(y):
            y = np.array([r.y for r in rows.select("y").limit(1).collect()], np.int64)
        cut = y.shape[1] // 2
        self.codes = codes = Codes(k_means(y[:, :cut], words), k_means(y[:, cut:], words))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell, ra, rb = codes.cells(matrix(b.column(3), b.num_rows))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(ra), pa.array(rb)], [*b.schema.names, "cell", "ra", "rb"])

        self.rows = materialise(rows.select("rid", "vec_id", "label", "y").mapInArrow(assign, "rid long, vec_id long, label long, y array<int>, cell int, ra double, rb double"), "cells")
        for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("ra").alias("ra"), F.max("rb").alias("rb")).collect():
            codes.rows.flat[r.cell], codes.radius[0].flat[r.cell], codes.radius[1].flat[r.cell] = r.n, r.ra, r.rb
        parts = F.array(*[F.lit(codes.parts(c)) for c in range(codes.rows.size)])

        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by([("vec_id", "ascending"), ("rid", "ascending")]).combine_chunks()
            y = matrix(t["y"].combine_chunks(), len(t)).astype(np.int32)
            held = [packed(t[c].to_numpy()) for c in ("vec_id", "rid", "label")]
            return pa.table({"cell": [t["cell"][0].as_py()], "part": [t["part"][0].as_py()], "ids": [held[0]], "rids": [held[1]], "labels": [held[2]], "y": [packed(y)]}, schema=BLOCKS)

        blocks = self.rows.select("rid", "vec_id", "label", "y", "cell", F.pmod(F.xxhash64("rid"), parts[F.col("cell")]).cast("int").alias("part")).groupBy("cell", "part").applyInArrow(pack, INDEX)
        self.name = f"multi_index_{uuid.uuid4().hex[:16]}"
        blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "part").format("parquet").option("path", new_folder(spark, "index")).saveAsTable(self.name)

    def visits(self, anchors: DataFrame, seed_rows: int | None = None) -> DataFrame:
        """Anchors of anchors(rid, label, y, lows, tops), packed in chunks for each block that they visit."""
        codes, dtype = self.codes, (np.int64, np.int64, np.int32, np.int64, np.int64)

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    b = batch.slice(at, CHUNK)
                    rid, label = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    y, lows, tops = (matrix(b.column(i), b.num_rows) for i in (2, 3, 4))
                    who: dict[int, list[int]] = {}
                    for i in range(b.num_rows):
                        for cell in codes.walk(y[i], int(lows[i].min()), seed_rows):
                            who.setdefault(cell, []).append(i)
                    for cell, k in who.items():
                        held = [packed(x[k].astype(d)) for x, d in zip((rid, label, y, lows, tops), dtype, strict=True)]
                        n = codes.parts(cell)
                        yield pa.RecordBatch.from_pydict({"cell": [cell] * n, "part": list(range(n)), **{c: [h] * n for c, h in zip(VISIT.names[2:], held, strict=True)}}, schema=VISIT)

        return anchors.select("rid", "label", "y", "lows", "tops").mapInArrow(visit, VISITS)

    def search(self, anchors: DataFrame, same_label: bool, seed_rows: int | None = None) -> DataFrame:
        """a_rid, top, vec_id, rid, score: the first PLACES rows of each anchor and top, among the rows of the same (or another) label with low <= score <= top."""
        width = self.codes.left.shape[1] + self.codes.right.shape[1]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    ids, rids, labels, y, a_rids, a_labels, a_y, a_lows, a_tops = (np.frombuffer(batch.column(i)[r].as_py(), t) for i, t in enumerate((np.int64, np.int64, np.int64, np.int32, np.int64, np.int64, np.int32, np.int64, np.int64)))
                    y, a_y = y.reshape(-1, width), a_y.reshape(-1, width)
                    a_lows, a_tops = a_lows.reshape(len(a_rids), -1), a_tops.reshape(len(a_rids), -1)
                    for at in range(0, len(a_rids), SLICE):
                        cut = slice(at, at + SLICE)
                        s = products(a_y[cut], y)
                        fits = (a_labels[cut, None] == labels) == same_label
                        fits &= a_rids[cut, None] != rids
                        for k in range(a_tops.shape[1]):
                            low, top = a_lows[cut, k], a_tops[cut, k]
                            i, j = first_places(np.where(fits & (s >= low[:, None]) & (s <= top[:, None]), s, LOWEST), PLACES)
                            # a spare place of an anchor with fewer tops has low above top and finds nothing
                            if len(i):
                                yield pa.RecordBatch.from_arrays([pa.array(a_rids[cut][i]), pa.array(top[i]), pa.array(ids[j]), pa.array(rids[j]), pa.array(s[i, j])], ["a_rid", "top", "vec_id", "rid", "score"])

        at = self.visits(anchors, seed_rows)
        joined = at.join(self.spark.table(self.name).hint("merge"), ["cell", "part"]).select("ids", "rids", "labels", "y", *VISIT.names[2:])
        places = Window.partitionBy("a_rid", "top").orderBy(F.desc("score"), "vec_id", "rid")
        return joined.mapInArrow(score, FOUND).withColumn("rank", F.row_number().over(places)).where(F.col("rank") <= PLACES)

    def drop(self) -> None:
        table = self.spark.table(self.name)
        self.spark.sql(f"DROP TABLE {self.name}")
        drop(self.spark, table, self.rows)


VISIT = pa.schema([("cell", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("a_rids", "a_labels", "a_y", "a_lows", "a_tops"))])
BLOCKS = pa.schema([("cell", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("ids", "rids", "labels", "y"))])


def first_places(s: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the largest entries of each row, ties by column, ``LOWEST`` never."""
    least = np.partition(s, -places, axis=1)[:, -places] if s.shape[1] > places else np.full(len(s), LOWEST)
    i, j = np.nonzero((s >= least[:, None]) & (s > LOWEST))
    order = np.lexsort((j, -s[i, j], i))
    i, j = i[order], j[order]
    if not len(i):
        return i, j
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    ahead = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    return i[ahead < places], j[ahead < places]


def mine(rows: DataFrame, anchors: int = ANCHORS, words: int = WORDS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors of ``whole_rows`` (ids divisible by ``anchors``)."""
    spark = rows.sparkSession
    if not rows.take(1):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = MultiIndex(rows, words)
    high = -LOWEST - 1
    # anchors of one cell come together: a chunk then visits few blocks
    own = materialise(index.rows.where(F.col("vec_id") % anchors == 0).select("rid", "vec_id", "label", "y", "cell").repartitionByRange("cell", "rid").sortWithinPartitions("cell", "rid"), "anchors")
    start = own.withColumns({"lows": F.array(F.lit(LOWEST)), "tops": F.array(F.lit(high))})
    lead = index.search(start, True, SEED_ROWS).groupBy("a_rid").agg(F.when(F.count(F.lit(1)) == PLACES, F.min("score")).alias("sure"))
    sure = own.join(lead, own["rid"] == lead["a_rid"], "left").withColumns({"lows": F.array(F.coalesce("sure", F.lit(LOWEST))), "tops": F.array(F.lit(high))})
    positives = materialise(index.search(sure, True), "positives")
    # the windows of an anchor are told by the positive score alone
    tops = materialise(positives.where("score >= 0").selectExpr("a_rid", "score AS top", "(4 * score + 4) div 5 AS low").distinct(), "windows")

    def windows(t: DataFrame) -> DataFrame:
        held = t.groupBy("a_rid").agg(F.sort_array(F.collect_list(F.struct("top", "low"))).alias("w"))
        # spare places have an empty window
        spare = F.array_repeat(F.struct(F.lit(high - 1).alias("top"), F.lit(high).alias("low")), F.lit(PLACES) - F.size("w"))
        held = held.withColumn("w", F.concat("w", spare))
        return own.join(held, own["rid"] == held["a_rid"]).withColumns({"lows": F.transform("w", lambda x: x["low"]), "tops": F.transform("w", lambda x: x["top"])})

    lead = index.search(windows(tops), False, SEED_ROWS).groupBy("a_rid", "top").agg(F.when(F.count(F.lit(1)) == PLACES, F.min("score")).alias("sure"))
    raised = tops.join(lead, ["a_rid", "top"], "left").select("a_rid", "top", F.greatest("low", "sure").alias("low"))
    found = materialise(index.search(windows(raised), False), "negatives")
    names = own.select(F.col("rid").alias("a_rid"), F.col("vec_id").alias("anchor_id"))
    out = positives.select("a_rid", F.col("vec_id").alias("positive_id"), F.col("score").alias("top")).join(found.select("a_rid", "top", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["a_rid", "top"]).join(names, "a_rid")
    out = materialise(out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("top").alias("positive_score"), "negative_score"), "mined")
    index.drop()
    drop(spark, own, positives, tops, found)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: hard negatives of all anchors, a tenth of the labels moved on."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = whole_rows(vectors.withColumn("label", label))
    out = mine(rows)
    drop(spark, rows)
    return out


OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS y FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, list_inner_product(a.y, b.y)::BIGINT AS score
      FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
      row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id, s.br)::INT AS rank
      FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
"""
