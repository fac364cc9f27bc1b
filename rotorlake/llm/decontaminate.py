"""Operator 7: benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; the words at its zeros are ignored, so a substitution there
leaves the seed's hash as it is.  Hashes of all seeds of the benchmark and of the documents are joined; every
hit gives a diagonal (where in the document the item would begin), and along it document and item are
compared word by word.  Equal items, and equal stretches of words around hits, are compared once for all their
copies; results are dealt to the rows afterwards.  Of all stretches of the diagonal of which at least ``MIN_SHARE`` matches, the one with
most matching words is the overlap; a document is contaminated by an item if these are at least ``MIN_WORDS``
(for shorter items: all words of the item but one in ten).

Documents pass once: seeds are tested against a bitmap of fixed size made from the benchmark's seeds (and,
while there are at most ``MAX_HASHES`` of them, against the hashes themselves), and only stretches of words
around the hits go on to the joins.  The bitmap has about ``BITS_PER_SEED`` bits a seed, from ``BITS`` to
``MOST_BITS``.  The benchmark itself is joined, not broadcast by hand.

Words are runs of digits, letters and non-ASCII characters, with A-Z lower-cased.  Items shorter than the
masks are sought by all their words.  Null and empty texts hit nothing; an item without words is never
found; very long texts are searched whole, in stretches around their hits.  Results carry the columns named in
``key``: with the default, rows with null ids are not reported and repeated rows give one row per id and item.
Items are compared row by row, and items of null id are reported under null.  Ties between overlaps go to the
longest, then the first in the document.  Extra columns are ignored, whatever their names.  Empty tables give an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, read, text_batches
from .textkernels import ALNUM, LOWER, mix, owners, span_hashes, texts

MASKS = ("1110100110", "1101011001", "1011001101", "1100101110")
MIN_WORDS, MIN_SHARE = 13, 0.8
BITS, MOST_BITS, BITS_PER_SEED = 1 << 24, 1 << 28, 32
#: Bits of the map that one task makes at a time.
BITS_PER_STRETCH = 1 << 19
MAX_HASHES = 1 << 21


def text_words(c) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[c.data]
    starts, ends, first = c.words(ALNUM, data)
    return span_hashes(data, starts, ends), first


def seeds(words: np.ndarray, first: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask the seed hashes and the index of each seed's first word; seeds never cross texts."""
    ends = np.repeat(first[1:], np.diff(first))
    for which, mask in enumerate(masks):
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, len(mask) * 1009 + int(mask, 2), np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                h += words[j : j + n] * mix(np.array([j + 77], np.uint64))[0]
        at = np.flatnonzero(np.arange(n) + len(mask) <= ends[:n])
        yield mix(h[at]), at


def item_seeds(benchmark: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """item_no, item_id, n_words, words (hashes as bytes), seeds(pos, hash); items shorter than the masks have one seed."""
    span = max(map(len, masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c in texts(b.column("text")):
                words, first = text_words(c)
                for k in range(c.n):
                    own = words[first[k] : first[k + 1]]
                    bounds = np.array([0, len(own)])
                    use = masks if len(own) >= span else ("1" * len(own),) if len(own) else ()
                    found = [(int(p), int(h)) for hs, at in seeds(own, bounds, use) for h, p in zip(hs.view(np.int64), at)]
                    rows.append({"item_id": b.column("item_id")[c.first + k].as_py(), "n_words": len(own), "words": own.tobytes(), "seeds": [{"pos": p, "hash": h} for p, h in found]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item_id", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("seeds", pa.list_(pa.struct([("pos", pa.int64()), ("hash", pa.int64())])))]))

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, n_words long, words binary, seeds array<struct<pos:long,hash:long>>")
    return items.withColumn("item_no", F.monotonically_increasing_id())


def bitmap_of(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bit ``hash mod bits`` (a power of two) set for every hash.

    Stretches of the map are made side by side, each from the distinct bits dealt to it; the driver puts together as
    many bytes as the map has.
    """
    wide = min(bits, BITS_PER_STRETCH)
    slots = hashes.select(F.col("hash").bitwiseAND(F.lit(bits - 1)).alias("slot")).distinct()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            slot = b.column("slot").to_numpy()
            for k in np.unique(slot // wide).tolist():
                at = slot[slot // wide == k] % wide
                np.bitwise_or.at(made.setdefault(k, np.zeros(wide // 8, np.uint8)), at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for k, m in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([m.tobytes()], pa.binary())], names=["stretch", "map"])

    out = np.zeros(bits // 8, np.uint8)
    for r in slots.repartition(F.expr(f"slot div {wide}")).mapInArrow(part, "stretch long, map binary").toLocalIterator():
        out[r.stretch * wide // 8 :][: wide // 8] = np.frombuffer(r.map, np.uint8)
    return out


HITS = pa.schema([("first", pa.int64()), ("words", pa.binary()), ("hits", pa.list_(pa.struct([("pos", pa.int64()), ("hash", pa.int64())])))])


def hit_stretches(docs: DataFrame, masks: tuple[str, ...], bitmap: np.ndarray, exact: np.ndarray | None, reach: int) -> DataFrame:
    """docs' other columns, first (word), words (hashes as bytes) and hits of the stretches that may hold an overlap."""
    bits = np.uint64(len(bitmap) * 8)
    keep = [c for c in docs.columns if c != "text"]

    def rows_of(b: pa.RecordBatch, owners_: list[int], rows: list[dict]) -> pa.RecordBatch:
        own, found = pa.array(owners_, pa.int64()), pa.RecordBatch.from_pylist(rows, schema=HITS)
        return pa.RecordBatch.from_arrays([*(b.column(k).take(own) for k in keep), *found.columns], names=[*keep, *HITS.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of = [], []
            for c in texts(b.column("text")):
                words, first = text_words(c)
                pos, val = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for h, at in seeds(words, first, masks):
                    slot = h & (bits - np.uint64(1))
                    hit = np.flatnonzero((bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                    h, at = h[hit], at[hit]
                    if exact is not None and len(h):
                        real = exact[np.minimum(np.searchsorted(exact, h), len(exact) - 1)] == h
                        h, at = h[real], at[real]
                    pos.append(at)
                    val.append(h)
                pos, val = np.concatenate(pos), np.concatenate(val)
                if not len(pos):
                    continue
                order = np.argsort(pos, kind="stable")
                pos, val = pos[order], val[order]
                owner = owners(first, len(words))[pos]
                new = np.ones(len(pos), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (pos[1:] - pos[:-1] > 2 * reach)
                edges = np.append(np.flatnonzero(new), len(pos))
                for s, e in zip(edges[:-1], edges[1:]):
                    k = int(owner[s])
                    a, z = max(int(first[k]), int(pos[s]) - reach), min(int(first[k + 1]), int(pos[e - 1]) + reach + 1)
                    of.append(c.first + k)
                    rows.append({"first": a - int(first[k]), "words": words[a:z].tobytes(), "hits": [{"pos": p - a, "hash": h} for p, h in zip(pos[s:e].tolist(), val[s:e].view(np.int64).tolist())]})
                    if len(rows) == 2000:
                        yield rows_of(b, of, rows)
                        rows, of = [], []
            yield rows_of(b, of, rows)

    schema = T.StructType([*(docs.schema[k] for k in keep), *T.StructType.fromDDL("first long, words binary, hits array<struct<pos:long,hash:long>>").fields])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, min_share: float = MIN_SHARE) -> tuple[int, int, int]:
    """(matching words, length, start in the item) of the stretch with most matches among those of enough share.

    With a score of ``1 - share`` for a match and ``-share`` for another word (in whole numbers), a stretch has
    the share exactly if the sum does not fall along it.  For each end, the first start whose sum is not above
    the end's own gives most matches; that is found in the running minimum.
    """
    a, z = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if z <= a:
        return 0, 0, 0
    same = doc[a + diagonal : z + diagonal] == item[a:z]
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    share = Fraction(str(min_share))
    total = np.append(0, np.cumsum(same * share.denominator - share.numerator))
    # stretches begin and end at a match: others only add words that do not match
    low = np.minimum.accumulate(total[at])
    first = np.searchsorted(-low, -total[at + 1])
    matched, size = np.arange(len(at)) - first + 1, at - at[np.minimum(first, len(at) - 1)] + 1
    k = int(np.lexsort((at - size, -size, -matched))[0])
    return int(matched[k]), int(size[k]), a + int(at[k] - size[k]) + 1


def least_words(n_words, min_words: int = MIN_WORDS):
    return np.where(n_words < min_words, np.maximum(1, np.ceil(n_words * 0.9)), min_words)


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``key``, item_id, matched, overlap_words, item_word, doc_word: one row per key and item found."""
    text_batches(docs.sparkSession)
    rows_of_items = materialise(item_seeds(benchmark, masks), "item-rows")
    # one item for all rows of equal words
    items = materialise(rows_of_items.groupBy("words").agg(F.min("item_no").alias("item_no"), F.first("n_words").alias("n_words"), F.first("seeds").alias("seeds")), "items")
    names = rows_of_items.select("item_id", "words").distinct().join(items.select("item_no", "words"), "words").select("item_no", "item_id")
    item_hashes = items.select("item_no", F.explode("seeds").alias("s")).select("item_no", F.col("s.pos").alias("item_pos"), "s.hash")
    facts = items.agg(F.max("n_words"), F.sum(F.size("seeds"))).head()
    reach, n_hashes = int(facts[0] or 0), int(facts[1] or 0)
    span = max(map(len, masks))
    short = [r[0] for r in items.where((F.col("n_words") > 0) & (F.col("n_words") < span)).select("n_words").distinct().limit(span).collect()]
    all_masks = (*masks, *("1" * n for n in sorted(short)))
    bitmap = bitmap_of(item_hashes.select("hash"), min(MOST_BITS, max(BITS, 1 << (BITS_PER_SEED * n_hashes).bit_length())))
    exact = None
    if 0 < n_hashes <= MAX_HASHES:
        exact = np.unique(item_hashes.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(np.uint64))
    rows = docs.select(*[F.col(k).cast("long").alias(k) if k == "doc_id" else F.col(k) for k in key], "text")
    rows = rows.where("doc_id is not null") if key == ("doc_id",) else rows
    own = [f"d_{k}" for k in key]
    found = hit_stretches(rows.toDF(*own, "text"), all_masks, bitmap, exact, reach)
    same = ["s1", "s2"]
    hashes = [F.xxhash64("words", "hits"), F.xxhash64(F.lit("second"), "words", "hits")]
    stretches = materialise(found.withColumns(dict(zip(same, hashes))), "stretches")
    # one stretch for all copies: partial aggregation drops them before the shuffle
    single = materialise(stretches.groupBy(*same).agg(F.first("words").alias("words"), F.first("hits").alias("hits")), "single-stretches")

    hits = single.select(*same, F.explode("hits").alias("h")).select(*same, F.col("h.pos").alias("pos"), F.col("h.hash").alias("hash"))
    diagonals = hits.join(item_hashes, "hash").select(*same, "item_no", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    diagonals = materialise(diagonals, "diagonals")
    pairs = diagonals.join(single.select(*same, F.col("words").alias("doc_words")), same).join(items.select("item_no", "n_words", F.col("words").alias("item_words")), "item_no")
    keep = [*same, "item_no"]
    new = ["matched", "overlap_words", "item_word", "doc_word"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("diagonal", "n_words")]
            of, out = [], []
            for k, (d, n, x, y) in enumerate(zip(*cols, b.column("doc_words"), b.column("item_words"))):
                m, size, start = overlap(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), d, min_share)
                if m >= least_words(n, min_words):
                    of.append(k)
                    out.append((m, size, start, start + d))
            own_rows = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(own_rows) for k in keep), *(pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4))], names=[*keep, *new])

    schema = T.StructType([*(pairs.schema[k] for k in keep), *(T.StructField(n, T.LongType()) for n in new)])
    verified = pairs.select(*keep, "diagonal", "n_words", "doc_words", "item_words").mapInArrow(verify, schema)
    # the overlaps of a stretch with an item, then of a row with an item: most matches, longest, first in the document
    best = F.max(F.struct("matched", "overlap_words", (-F.col("doc_word")).alias("o"), "item_word", "doc_word")).alias("x")
    verified = materialise(verified.groupBy(*keep).agg(best).select(*keep, "x.*"), "overlaps")
    found = verified.join(names, "item_no").join(stretches.select(*same, *own, "first"), same).withColumn("doc_word", F.col("doc_word") + F.col("first"))
    return found.groupBy(*own, "item_id").agg(best).select(*[F.col(o).alias(k) for o, k in zip(own, key)], "item_id", *[f"x.{n}" for n in new])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
