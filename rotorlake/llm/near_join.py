"""Operator 10: n-gram Jaccard join by a MinHash LSH forest.

Documents are sets of shingles of five words; links are pairs with a Jaccard similarity of 0.8 or more.

1. One pass over the texts makes a signature of ``TREES`` paths of ``MAX_DEPTH`` MinHash values, one path per
   trie.  ``depth_for`` says how far a prefix must be shortened for a pair at the threshold to meet in some trie
   with at least ``RECALL``.
2. Documents with the same words are one class (copies); only its first row goes on.
3. Each subtree (documents with that shortest prefix in one trie) is sorted by its full paths.  A document is
   compared with the first of its run at full depth; only while it is not covered there (signatures within
   ``RADIUS`` places) is its prefix shortened, value by value, down to the subtree; ``walk_tries`` tells where it stopped.  What no one covers stands
   for itself.  Then the covering documents alone are compared, with the limit widened by both radii: places
   that differ obey the triangle inequality, so no pair is missed that a comparison of all with all would find.
   Subtrees over ``BLOCK_DOCS`` are dealt into slices first, and the slices' covering documents meet afterwards.
   Candidates are linked as stars; their connected components are found.
4. Each component is verified exactly.  In one of more than a block, a pivot set (the shingles of more than half
   of its documents) comes first: Jaccard distance is a metric, so documents within half the allowed distance of the
   pivot are all linked and need no comparison; the others are compared with everything, in blocks of
   bounded size.  A block gives one row per document (its links and the smallest document it is joined with).
5. Components of the verified links are the final classes.

Rows are told apart by id and text, so one id may stand for several texts, and rows with null ids take part.
Words are runs of other than white space.  A text of one to four words is a single shingle of all its words;
null texts and texts without words link to nothing and are classes of their own.  Repeated rows (same id and
text) are copies of each other.  A class is named by its smallest id; if all its ids are null, negative or stand
for several texts, by a number of 2**62 or more (null for a row of null id alone).  Very long texts are whole
sets, of a block of their own if need be.  Extra columns are ignored, whatever their names.  An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import far_blocks, in_blocks, run_groups
from .common import drop, materialise, read, same_row, text_batches, text_keys
from .components import components
from .decontaminate import bitmap_of
from .textkernels import NON_SPACE, mix, shingle_hashes, span_hashes, texts

SHINGLE, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, RECALL = 18, 8, 0.999
#: Documents, and shingles, that a block holds on average at most.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
#: Places in which a signature may differ from the one that covers it.
RADIUS = 9
#: Rows that their id does not name alone are numbered from here on.
UNNAMED = 1 << 62
#: Bits a row, least and most bits of the map that spares texts the shuffle.
BITS_PER_ROW, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 28


def depth_for(recall: float = RECALL, trees: int = TREES, threshold: float = THRESHOLD, most: int = MAX_DEPTH) -> int:
    """The longest prefix with which a pair at the threshold meets with the target recall."""
    for depth in range(most, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def least_agreement(n: int, threshold: float, chance: float = 1e-7) -> int:
    """The number of agreeing places that a pair at the threshold misses with less than ``chance``."""
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        if total > chance:
            return k
    return n


def text_shingles(c) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, each text's first word, shingle hashes, each text's first shingle, of a chunk."""
    starts, ends, first = c.words(NON_SPACE)
    words = span_hashes(c.data, starts, ends)
    g, at = shingle_hashes(words, first, SHINGLE)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
    if len(short):
        more, where = [], []
        for k in short.tolist():
            h = np.uint64(len(range(first[k], first[k + 1])))
            with np.errstate(over="ignore"):
                for w in words[first[k] : first[k + 1]]:
                    h = mix(np.array([h * np.uint64(31) + w]))[0]
            more.append(h)
            where.append(first[k])
        at = np.concatenate([at, np.array(where, np.int64)])
        order = np.argsort(at, kind="stable")
        g, at = np.concatenate([g, np.array(more, np.uint64)])[order], at[order]
    return words, first, g, np.searchsorted(at, first)


def _copy_keys(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    keys = []
    for seed in (1, 2):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words ^ mix(place + np.uint64(seed << 40))), out=total[1:])
        keys.append(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def signatures(docs: DataFrame, trees: int = TREES, depth: int | None = None, most: int = MAX_DEPTH) -> DataFrame:
    """doc_id, t1, t2, k1, k2 (hash of the words), n_words, n_shingles, paths (shortest prefix per trie), sig (a byte a value)."""
    depth = depth or depth_for(trees=trees)
    n = trees * most
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
    keep = ["doc_id", "t1", "t2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in texts(b.column("text")):
                words, first, g, s_first = text_shingles(c)
                k1, k2 = _copy_keys(words, first)
                some = np.flatnonzero(np.diff(s_first) > 0)
                sig = np.zeros((n, c.n), np.uint64)
                for i, f in enumerate(factors):
                    if len(some):
                        sig[i, some] = np.minimum.reduceat(mix_short(g * f), s_first[some])
                paths = np.zeros((trees, c.n), np.uint64)
                for t in range(trees):
                    h = np.full(c.n, t + 1, np.uint64)
                    for d in range(depth):
                        h = mix(h * np.uint64(31) + sig[t * most + d])
                    paths[t] = h
                flat = paths.T.reshape(-1).view(np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.arange(c.n + 1, dtype=np.int32) * trees), pa.array(flat))
                low = np.ascontiguousarray((mix(sig.T) & np.uint64(255)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(c.first, c.n) for k in keep), pa.array(k1), pa.array(k2), pa.array(np.diff(first)), pa.array(np.diff(s_first)), places, pa.array([r.tobytes() for r in low], pa.binary())],
                    names=[*keep, "k1", "k2", "n_words", "n_shingles", "paths", "sig"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), "text")
    return rows.mapInArrow(run, "doc_id long, t1 long, t2 long, k1 long, k2 long, n_words long, n_shingles long, paths array<long>, sig binary")


def mix_short(x: np.ndarray) -> np.ndarray:
    """Enough mixing for the order of products by odd factors: the high half folded into the low one."""
    x ^= x >> np.uint64(32)
    return x


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes over edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
    return root


def _groups(batches: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.RecordBatch, np.ndarray]:
    """One batch of all, and where its groups begin (with the end)."""
    t = pa.Table.from_batches(batches).combine_chunks()
    b = t.to_batches()[0]
    change = np.zeros(b.num_rows, bool)
    change[0] = True
    for k in keys:
        v = b.column(k).to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    return b, np.append(np.flatnonzero(change), b.num_rows)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
COVERED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("stop", pa.int64()), ("path", pa.int64()), ("radius", pa.int64()), ("sig", pa.binary())])


def cover(sig: np.ndarray, tails: np.ndarray, radius: int, stop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a slice sorted by ``tails`` the row that covers it, and how far its own covered rows are.

    From full depth on, the first open row of a run of equal prefixes covers the open rows within ``radius``
    places; rows that stay open go on with a prefix shorter by one value.  At the last one, rows that cover others
    already come first, then each open row in turn.  ``stop`` (zeros) receives how many values of their tails
    covered rows still had.
    """
    m, n = sig.shape
    by, reach, open_ = np.arange(m), np.zeros(m, np.int64), np.ones(m, bool)
    stop = np.zeros(m, np.int64) if stop is None else stop

    def take(k: int, rows: np.ndarray, d: int) -> None:
        apart = n - (sig[rows] == sig[k]).sum(axis=1)
        hit = (apart <= radius) & (rows != k)
        if hit.any():
            by[rows[hit]] = k
            stop[rows[hit]] = d
            open_[rows[hit]] = open_[k] = False
            reach[k] = max(reach[k], int(apart[hit].max()))

    for d in range(tails.shape[1], 0, -1):
        new = np.append(True, (tails[1:, :d] != tails[:-1, :d]).any(axis=1))
        edges = np.append(np.flatnonzero(new), m)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            rows = s + np.flatnonzero(open_[s:e])
            if len(rows) > 1:
                take(int(rows[0]), rows, d)
    for k in [*np.unique(by[by != np.arange(m)]).tolist(), *np.flatnonzero(open_).tolist()]:
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        if by[k] == k:
            take(k, rows, 0)
    return by, reach


def close_pairs(sig: np.ndarray, radius: np.ndarray, least: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that agree in ``least`` places less both radii; of two sides only pairs across."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(sig) - 1):
        hit = (sig[i + 1 :] == sig[i]).sum(axis=1) >= least - radius[i] - radius[i + 1 :]
        if side is not None:
            hit &= side[i + 1 :] != side[i]
        j = np.flatnonzero(hit) + i + 1
        left.append(np.full(len(j), i))
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(len(column), n)


def walk_tries(reps: DataFrame, trees: int, threshold: float, most: int = MAX_DEPTH) -> DataFrame:
    """a, b, stop, path, radius, sig: where each document's prefix stopped in the tries in which it has company.

    Rows with ``b`` are candidates: ``a`` left the trie for ``b`` when its prefix had been shortened to ``stop`` values.
    Rows without are the covering documents of the slices of subtrees over ``BLOCK_DOCS``, which have still to meet.
    """
    n = trees * most
    least = least_agreement(n, threshold)
    depth = depth_for(trees=trees, threshold=threshold, most=most)
    spread = reps.select("node", F.posexplode("paths").alias("trie", "path"))
    shared = materialise(spread.groupBy("path").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "prefixes")
    members = materialise(spread.join(shared, "path"), "members")
    slices = F.ceil(F.col("m") / F.lit(float(BLOCK_DOCS))).cast("long")
    rest = F.substring("sig", F.col("trie") * most + depth + 1, F.lit(max(1, most - depth)))
    dealt = members.join(reps.select("node", "sig"), "node").select("path", F.pmod(F.xxhash64("node"), slices).alias("slice"), (slices == 1).alias("alone"), rest.alias("rest"), "node", "sig")

    def walk(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, at = _groups(batches, ["path", "slice"])
        ids, path = b.column("node").to_numpy(), b.column("path").to_numpy()
        sig, tails = _matrix(b.column("sig"), n), _matrix(b.column("rest"), max(1, most - depth))
        alone = b.column("alone").to_numpy(zero_copy_only=False)
        size = np.diff(at)
        two = at[:-1][(size == 2) & alone[at[:-1]]]
        agree = (sig[two] == sig[two + 1]).sum(axis=1)
        two, agree = two[agree >= least], agree[agree >= least]
        common = np.cumprod(tails[two] == tails[two + 1], axis=1).sum(axis=1) if most > depth else np.zeros(len(two), np.int64)
        out_a, out_b, stops = [ids[two + 1]], [ids[two]], [depth + np.where(agree >= n - RADIUS, common, 0)]
        standing, reaches = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            m = e - s
            if alone[s] and m <= 2:
                continue
            stop = np.zeros(m, np.int64)
            by, reach = cover(sig[s:e], tails[s:e], RADIUS, stop)
            heads = np.flatnonzero(by == np.arange(m))
            if alone[s]:
                left, right = close_pairs(sig[s:e][heads], reach[heads], least)
                by = _stars(m, np.append(heads[left], np.arange(m)), np.append(heads[right], by))
            else:
                standing.append(s + heads)
                reaches.append(reach[heads])
            hang = np.flatnonzero(by != np.arange(m))
            out_a.append(ids[s:e][hang])
            out_b.append(ids[s:e][by[hang]])
            stops.append(np.minimum(depth + stop[hang], most))
        out_a, out_b, stops, standing, reaches = map(np.concatenate, (out_a, out_b, stops, standing, reaches))
        none = lambda k: pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(out_a), pa.array(out_b), pa.array(stops.astype(np.int64)), none(len(out_a)), none(len(out_a)), pa.nulls(len(out_a), pa.binary())], schema=COVERED)
        yield pa.RecordBatch.from_arrays([pa.array(ids[standing]), none(len(standing)), none(len(standing)), pa.array(path[standing]), pa.array(reaches), b.column("sig").take(pa.array(standing))], schema=COVERED)

    return materialise(run_groups(dealt, ["path", "slice"], ["rest", "node"], walk, "a long, b long, stop long, path long, radius long, sig binary"), "covered")


def candidate_edges(reps: DataFrame, trees: int, threshold: float, most: int = MAX_DEPTH) -> DataFrame:
    """Star edges (a, b) between documents that share a prefix in some trie and whose signatures agree enough."""
    n, least = trees * most, least_agreement(trees * most, threshold)
    walked = walk_tries(reps, trees, threshold, most)
    edges = walked.where("b is not null").select("a", "b")
    heads = walked.where("b is null").select("path", F.col("a").alias("node"), "radius", "sig")
    if not heads.take(1):
        return edges.distinct()
    sized = heads.groupBy("path").agg(F.count(F.lit(1)).alias("heads"))
    blocks = in_blocks(heads.join(sized, "path"), "path", F.ceil(F.col("heads") / F.lit(float(BLOCK_DOCS))), "node")

    def meet(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, at = _groups(batches, ["path", "pair"])
        ids, sig, radius = b.column("node").to_numpy(), _matrix(b.column("sig"), n), b.column("radius").to_numpy()
        side, alone = b.column("side").to_numpy(), b.column("alone").to_numpy(zero_copy_only=False)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            root = _stars(e - s, *close_pairs(sig[s:e], radius[s:e], least, None if alone[s] else side[s:e]))
            hang = np.flatnonzero(root != np.arange(e - s))
            out_a.append(ids[s:e][hang])
            out_b.append(ids[s:e][root[hang]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], schema=EDGES)

    met = run_groups(blocks.select("path", "pair", "side", "alone", "node", "radius", "sig"), ["path", "pair"], ["node"], meet, "a long, b long")
    return edges.union(met).distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Each row's other columns and ``shingles``: its distinct shingle hashes, sorted, as bytes."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in texts(b.column("text")):
                _, _, g, first = text_shingles(c)
                sets = [np.unique(g[s:e]).tobytes() for s, e in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(c.first, c.n) for k in keep), pa.array(sets, pa.binary())], names=[*keep, "shingles"])

    schema = docs.select(*keep).schema
    return docs.select(*keep, "text").mapInArrow(run, schema.add("shingles", "binary"))


def common_counts(sets: list[np.ndarray], step: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of a block."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        return np.array([[sizes[0], n := len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [n, sizes[1]]])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    everywhere = int((count == m).sum())
    keep = (count > 1) & (count < m)
    number = np.cumsum(keep) - 1
    used = keep[column]
    row, column = row[used], number[column[used]]
    out = np.full((m, m), float(everywhere))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(keep.sum()), step):
        s, e = np.searchsorted(column, [a, a + step])
        has = np.zeros((m, step), np.float32)
        has[row[s:e], column[s:e] - a] = 1
        out += has @ has.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out


VERIFIED = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def map_bits(n: int) -> int:
    """Bits of a map of n rows, a power of two; 0 if so many would pass the most bits that the map tells little."""
    return 0 if 2 * n > MOST_BITS else min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ROW * n).bit_length()))


def maybe_chosen(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """doc_id, t1, t2, text of the rows whose key's hash is in the bitmap; some others pass too."""
    mask = len(bitmap) * 8 - 1
    keep = ["doc_id", "t1", "t2", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column("hash").to_numpy() & mask
            hit = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep], names=keep).filter(pa.array(hit.astype(bool)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), "text")
    return rows.withColumn("hash", F.xxhash64("t1", "t2")).mapInArrow(run, "doc_id long, t1 long, t2 long, text string")


def without_rows(rows: DataFrame, leave: DataFrame) -> DataFrame:
    """Rows (with ``t1``, ``t2``) that are not in leave(k_doc_id, k_t1, k_t2).

    Only rows that a bitmap sized by their count says may be among them are shuffled to find out; all others stay where
    they lie, in a second pass.  Where so many leave that no bitmap within ``MOST_BITS`` would tell, all rows are
    merged with the sorted keys.
    """
    bits = map_bits(leave.count())
    if not bits:
        return rows.join(leave.hint("merge"), same_row(), "left_anti")
    bitmap = bitmap_of(leave.select(F.xxhash64("k_t1", "k_t2").alias("hash")), bits)
    mask, keep = len(bitmap) * 8 - 1, rows.columns

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                slot = b.column("leave_hash").to_numpy() & mask
                hit = ((bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
                yield pa.RecordBatch.from_arrays([b.column(k) for k in keep], names=keep).filter(pa.array(hit == wanted))

        return rows.withColumn("leave_hash", F.xxhash64("t1", "t2")).mapInArrow(run, rows.schema)

    return part(False).unionByName(part(True).join(leave.hint("merge"), same_row(), "left_anti"))


def pivots(sets: DataFrame) -> DataFrame:
    """component, pivot: the shingles that more than half of a component's documents (component, m, shingles) hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, m = b.column("component").to_numpy(), b.column("m").to_numpy()
            for g in np.unique(group).tolist():
                rows = np.flatnonzero(group == g)
                values, n = np.unique(np.concatenate([np.frombuffer(b.column("shingles")[i].as_buffer(), np.int64) for i in rows.tolist()]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), x)) for x in (g, m[rows[0]])] + [pa.array(values), pa.array(n.astype(np.int64))], names=["component", "m", "shingle", "n"])

    counted = sets.select("component", "m", "shingles").mapInArrow(count, "component long, m long, shingle long, n long")
    counted = counted.groupBy("component", "m", "shingle").agg(F.sum("n").alias("n")).where("2 * n > m")
    return counted.groupBy("component").agg(F.collect_list("shingle").alias("pivot"))


def near_pivot(sets: DataFrame, threshold: float) -> DataFrame:
    """Adds ``near``: whether a document of a large component is within half the allowed distance of its pivot.

    A pivot has at most twice as many shingles as the component's documents have on average; it is copied to
    every block of them.
    """
    least, keep = (1 + threshold) / 2, sets.columns
    middle = pivots(sets).select(F.col("component").alias("p_component"), "pivot")
    blocks = sets.select("component", "blocks").distinct().join(middle, F.col("component") == F.col("p_component"))
    blocks = materialise(blocks.select("p_component", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("p_cut")), "pivots")
    rows = sets.withColumn("cut", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.join(blocks, (F.col("component") == F.col("p_component")) & (F.col("cut") == F.col("p_cut")), "left").select(*keep, "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.zeros(b.num_rows, bool)
            for i, (own, middle) in enumerate(zip(b.column("shingles"), b.column("pivot"))):
                if middle.is_valid:
                    a, p = np.frombuffer(own.as_buffer(), np.int64), middle.values.to_numpy()
                    both = len(np.intersect1d(a, p, assume_unique=True))
                    near[i] = both >= least * (len(a) + len(p) - both) + 1e-9
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(near)], names=[*keep, "near"])

    return rows.mapInArrow(run, sets.select(*keep).schema.add("near", "boolean"))


def verified_links(docs: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """node, links (rows of other classes that it links to, in this block), root (smallest it is joined with here)."""
    sized = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("total")).where("m > 1")
    blocks = F.ceil(F.greatest(F.col("m") / F.lit(float(BLOCK_DOCS)), F.col("total") / F.lit(float(BLOCK_SHINGLES)))).cast("long")
    sized = materialise(sized.withColumn("blocks", blocks), "component-sizes")
    chosen = materialise(candidates.join(sized, "component"), "chosen")
    # only texts that may be chosen are shuffled: a bitmap tells most others where they lie, unless most are chosen
    bits = map_bits(chosen.count())
    if bits:
        maybe = maybe_chosen(docs, bitmap_of(chosen.select(F.xxhash64("t1", "t2").alias("hash")), bits))
    else:
        maybe = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), "text")
    mine = chosen.withColumnsRenamed({"doc_id": "c_id", "t1": "c_1", "t2": "c_2"})
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("t1") == F.col("c_1")) & (F.col("t2") == F.col("c_2"))
    rows = maybe.hint("merge").join(mine, same).select("text", "node", "component", "copies", "m", "total", "blocks")
    sets = materialise(shingle_sets(rows), "shingle-sets")
    keep = ["component", "pair", "side", "alone", "node", "copies", "shingles"]
    dealt = in_blocks(sets.where("blocks = 1"), "component", F.lit(1), "node").select(*keep)
    sure = None
    if sized.where("blocks > 1").take(1):
        large = materialise(near_pivot(sets.where("blocks > 1"), threshold), "pivoted")
        # repeated rows of one id and text are one node
        flags = large.select("component", "node", "copies", "near", F.length("shingles").alias("bytes")).distinct()
        part = lambda x: F.greatest(F.count_if(x) / F.lit(float(BLOCK_DOCS)), F.sum(F.when(x, F.col("bytes"))) / F.lit(8.0 * BLOCK_SHINGLES))
        about = flags.groupBy("component").agg(
            F.coalesce(F.ceil(part(F.col("near"))), F.lit(0)).cast("long").alias("near_blocks"),
            F.coalesce(F.ceil(part(~F.col("near"))), F.lit(0)).cast("long").alias("far_blocks"),
            F.sum(F.when(F.col("near"), F.col("copies"))).alias("near_copies"),
            F.min(F.when(F.col("near"), F.col("node"))).alias("root"),
        )
        about = materialise(about, "pivot-counts")
        dealt = dealt.union(far_blocks(large.join(about, "component"), "node").select(*keep))
        sure = flags.where("near").join(about, "component").select("node", (F.col("near_copies") - F.col("copies")).alias("links"), "root").where("links > 0")

    def work(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, at = _groups(batches, ["component", "pair"])
        ids, copies = b.column("node").to_numpy(), b.column("copies").to_numpy()
        side, alone = b.column("side").to_numpy(), b.column("alone").to_numpy(zero_copy_only=False)
        column, out = b.column("shingles"), []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            # repeated rows of one id and text are one node, and stand side by side
            k = s + np.flatnonzero(np.append(True, ids[s + 1 : e] != ids[s : e - 1]))
            if len(k) < 2:
                continue
            sets = [np.frombuffer(column[i].as_buffer(), np.uint64) for i in k.tolist()]
            sizes = np.array([len(x) for x in sets])
            both = common_counts(sets)
            linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if not alone[s]:
                linked &= side[k][:, None] != side[k][None, :]
            root = _stars(len(k), *np.nonzero(linked))
            links = linked @ copies[k]
            some = np.flatnonzero(links)
            if len(some):
                out.append((ids[k][some], links[some], ids[k][root[some]]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], schema=VERIFIED)

    found = run_groups(dealt, ["component", "pair"], ["node"], work, "node long, links long, root long")
    return found.union(sure) if sure is not None else found


def named_rows(signed: DataFrame) -> DataFrame:
    """Adds ``node``: the row's id, or a number from ``UNNAMED`` on where the id is null, out of range or of several texts."""
    text = F.struct("t1", "t2")
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("z")).where("a <> z").select(F.col("doc_id").alias("s_id"))
    several = materialise(several, "ids-of-several")
    alone = F.col("doc_id").isNotNull() & F.col("doc_id").between(0, UNNAMED - 1)
    if several.take(1):
        signed = signed.join(several, F.col("doc_id") == F.col("s_id"), "left")
        alone &= F.col("s_id").isNull()
    return signed.withColumn("node", F.when(alone, F.col("doc_id")).otherwise(F.col("row_no") + F.lit(UNNAMED))).drop("s_id")


def representatives(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All rows with their signatures, these with names (``node``), the classes of equal word sequences, and one signed row for each class."""
    text_batches(docs.sparkSession)
    depth = depth_for(trees=trees, threshold=threshold)
    raw = materialise(signatures(docs, trees, depth).withColumn("row_no", F.monotonically_increasing_id()), "signatures")
    signed = named_rows(raw)
    worded = signed.where("n_words > 0")
    first = F.min(F.struct("node", "row_no"))
    classes = materialise(worded.groupBy("k1", "k2").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")).select("k1", "k2", F.col("first.node").alias("rep"), F.col("first.row_no").alias("row_no"), "copies"), "classes")
    reps = materialise(
        raw.select("row_no", "doc_id", "t1", "t2", "n_shingles", "paths", "sig").join(classes.select("row_no", F.col("rep").alias("node"), "copies"), "row_no"),
        "representatives",
    )
    return raw, signed, classes, reps


def near_rows(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), class_key (one number per class), n_links, for every row."""
    spark = docs.sparkSession
    raw, signed, classes, reps = representatives(docs, threshold, trees)
    edges = candidate_edges(reps, trees, threshold)
    grouped = components(edges)
    candidates = grouped.join(reps.select("node", "doc_id", "t1", "t2", "copies", "n_shingles"), "node")
    links = materialise(verified_links(docs, candidates, threshold), "links")
    final = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    about = materialise(counted.join(final, "node", "full").withColumnRenamed("node", "a_node"), "about")
    # only classes of several rows need a join; all others stand for themselves
    several = materialise(classes.where("copies > 1").select(F.col("k1").alias("s_1"), F.col("k2").alias("s_2"), "rep", "copies"), "copies")
    rows = signed.select("doc_id", "t1", "t2", "node", F.when(F.col("n_words") > 0, F.col("k1")).alias("k1"), "k2")
    rows = rows.join(several, (F.col("k1") == F.col("s_1")) & (F.col("k2") == F.col("s_2")), "left")
    named = materialise(rows.select("doc_id", "t1", "t2", F.coalesce("rep", "node").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), "named")
    drop(spark, raw, reps)
    return named.join(about, named.rep == F.col("a_node"), "left").select(
        "doc_id", "t1", "t2", F.coalesce("component", "rep").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    )


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """doc_id, class_id (smallest id it is linked to, directly or through others), n_links, for every row."""
    unnamed = F.col("doc_id").isNull() & (F.col("n_links") == 0)
    return near_rows(docs, threshold, trees).select("doc_id", F.when(~unnamed, F.col("class_key")).alias("class_id"), "n_links")


def op10_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))
