"""Operator 8: secret scans whose false positives a random forest removes.

Candidates are runs of 16 or more of ``[A-Za-z0-9+/_-]``, such runs joined by dots, every value that follows an
assignment name (quoted, or up to white space; any length and characters) and passwords in URLs; a span found
twice counts once.  Each gets figures of its length, its character transitions, how much of it the corpus's own
dictionary covers, the words inside it, its path (the source column) and its neighbouring words.  A random forest
trained on labelled findings tells secrets from look-alikes.  Words weigh by their log-odds in the labelled findings that
have them often enough (``vocabulary``): foreign prose around a candidate says nothing.  Finding and measuring take linear time however long a
run is, also where assigned values nest: values with one end are measured together, from the end backwards, and a value's
own words are those before the next value inside it.

The dictionary is a table of fixed size with the frequency of every four-letter piece (hashed) over all
texts.  Labelled findings are a parameter: (doc_id, start, label) of candidates in the documents.  Where none are
given, those of ``secret_findings`` are learnt from: ``N_FINDINGS`` short texts made from a seed, whose labels say what
was written there and owe nothing to the patterns below; one in five is held out for measuring.  At most
``MAX_TRAIN`` findings, the first by hash of each label, are fitted.  ``by_rule`` tells what the patterns alone
(published key formats, and assigned values with a digit) would have reported; it is not an input of the forest.

Null and empty texts have no candidates, very long ones are scanned whole; null sources are a path of their own;
repeated rows give repeated findings; findings of null ids are scored like others.  If the labels given are all
alike, every finding gets that label.  Ties at a probability of 0.5 are secrets.  Extra columns are ignored,
whatever their names.  An empty table gives no findings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, materialise, read
from .secret_findings import labelled_findings
from .textkernels import LOWER, mix, texts

LEAST = 16
BINS = 1 << 15
MAX_TRAIN = 20_000
TREES, DEPTH, SEED = 40, 10, 7
#: Words of each place whose weight is learnt at most, and labelled findings that must have them.
MOST_WORDS, LEAST_SEEN = 300, 10
PLACES = ("near", "left", "right", "own", "path")
WORDS = re.compile(r"[^\W\d_]+")

_RUN = np.zeros(256, bool)
_RUN[list(b"+/_-")] = True
_RUN[0x30:0x3A] = _RUN[0x41:0x5B] = _RUN[0x61:0x7B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True

#: Published key formats, and names that values are assigned to.
FORMATS = re.compile(rb"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[baprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]++\.eyJ[0-9A-Za-z_-]++\.[0-9A-Za-z_-]*")
ASSIGNED = re.compile(r"(?i)(?:pass(?:word|wd)?|token|secret|api[_-]?key|credential)s?[\"']?\s*[=:]\s*[\"']?$")

#: Spans of any length: assigned values, passwords in URLs; and runs joined by dots.  No pattern looks at a byte again and again.
NAMED = re.compile(rb"""(?i)(?:pass(?:word|wd)?|pwd|token|secret(?:[_-]\w{1,20})?|api[_-]?key|credential)s?["']?\s*[=:]\s*""")
QUOTED = {0x22: re.compile(rb'"((?:[^"\\\r\n]|\\.)++)"'), 0x27: re.compile(rb"'((?:[^'\\\r\n]|\\.)++)'")}
STOPS = re.compile(rb"""[\s"']""")
LOGINS = re.compile(rb"://[^\s/:@\"']*:([^\s/\"']+)@")
DOTTED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\.[A-Za-z0-9+/_-]++)++")
LOGIN = re.compile(r"://[^\s/:@\"']*:$")
#: What may stand right before a value.
MARKS = (b"=", b":", b'"', b"'", b"/", b"@")
TAIL = frozenset(b".,;)]}>")


def spans(text: bytes) -> set[tuple[int, int]]:
    """Start and end of the candidates of a text that are not plain runs."""
    out = {m.span() for m in DOTTED.finditer(text) if m.end() - m.start() >= LEAST}
    out |= {m.span(1) for m in LOGINS.finditer(text)}
    stop, kept = 0, 0
    for m in NAMED.finditer(text):
        a = m.end()
        if a == len(text):
            break
        if text[a] in QUOTED:
            if q := QUOTED[text[a]].match(text, a):
                out.add(q.span(1))
                continue
            a += 1
        if stop <= a:
            # where the run ends, and where it ends without the marks that end a clause: once for all values in it
            found = STOPS.search(text, a)
            stop = found.start() if found else len(text)
            kept = stop
            while kept > a and text[kept - 1] in TAIL:
                kept -= 1
        if stop > a:
            out.add((a, kept if kept > a else stop))
    return out


def pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of the four letters that begin at each byte, and whether there are four."""
    n = max(0, len(data) - 3)
    low = LOWER[data]
    ok = np.ones(n, bool)
    code = np.zeros(n, np.uint64)
    for j in range(4):
        ok &= _LETTER[low[j : j + n]]
        code = code * np.uint64(31) + low[j : j + n]
    return (mix(code) & np.uint64(BINS - 1)).astype(np.int64), ok


def dictionary(docs: DataFrame) -> np.ndarray:
    """Occurrences of the four-letter pieces of all texts, by bin."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            for c in texts(b.column("text")):
                bins, ok = pieces(c.data)
                total += np.bincount(bins[ok], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            for x in b.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    parts = docs.select("text").mapInArrow(count, "counts binary").repartition(16).mapInArrow(add, "counts binary")
    return np.frombuffer(parts.coalesce(1).mapInArrow(add, "counts binary").head()[0], np.int64)


_KIND = np.full(256, 3, np.int64)
_KIND[0x30:0x3A], _KIND[0x41:0x5B], _KIND[0x61:0x7B] = 0, 1, 2
_HEX = np.zeros(256)
_HEX[list(b"0123456789abcdefABCDEF")] = 1.0
_WORDY = np.zeros(256, bool)
_WORDY[0x41:0x5B] = _WORDY[0x61:0x7B] = _WORDY[0x80:] = True


def figures(data: np.ndarray, starts: list[int], usual: np.ndarray) -> np.ndarray:
    """A row for each start (rising) of the bytes from there to the end of data: length, shares of kinds, transitions, entropy, hex share, longest word, dictionary coverage.

    Bytes are counted by the stretch between starts that they are in, and the counts added up from the end.
    """
    k, n = len(starts), len(data)
    seg = np.repeat(np.arange(k), np.diff([*starts, n]))

    def suffixes(codes: np.ndarray, width: int, weights=None) -> np.ndarray:
        got = np.bincount(seg[: len(codes)] * width + codes, weights, minlength=k * width)[: k * width].reshape(k, width)
        return np.cumsum(got[::-1], axis=0)[::-1].astype(np.float64)

    size = (n - np.asarray(starts))[:, None].astype(np.float64)
    kinds = _KIND[data]
    moves = suffixes(kinds[:-1] * 4 + kinds[1:], 16)
    letters, code = np.unique(data, return_inverse=True)
    c = suffixes(code, len(letters)) / size
    entropy = -(c * np.log2(np.where(c > 0, c, 1))).sum(axis=1, keepdims=True)
    hexed = suffixes(np.zeros(n, np.int64), 1, _HEX[data]) / size
    # letters from each byte to the end of its word; the longest from a start onward
    ends = np.minimum.accumulate(np.where(_WORDY[data], n, np.arange(n))[::-1])[::-1]
    longest = np.maximum.accumulate((ends - np.arange(n))[::-1])[::-1][starts][:, None] / size
    bins, ok = pieces(data)
    covered = suffixes(np.zeros(len(bins), np.int64), 1, usual[bins] * ok) / np.maximum(1, size - 3)
    return np.hstack([size, suffixes(kinds, 4) / size, moves / np.maximum(1, size - 1), entropy, hexed, longest, covered])


def words_of(text: bytes) -> list[str]:
    return [w.lower() for w in WORDS.findall(text.decode("utf-8", "ignore"))]


FOUND = "start long, length long, rule int, numbers array<double>, left array<string>, right array<string>, own array<string>, path array<string>"


def candidates(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, start (byte), length, rule (1 if a known format or an assigned value), numbers, and the words of each place."""
    usual = counts > counts.sum() / BINS
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), *[pa.list_(pa.string())] * 4]
    names = [x.split()[0] for x in FOUND.split(", ")]

    def of(text: bytes, runs: list[tuple[int, int]], path: list[str]) -> Iterator[tuple]:
        by_end: dict[int, list[int]] = {}
        for s, e in sorted(spans(text).union(runs)):
            by_end.setdefault(e, []).append(s)
        for e, starts in by_end.items():
            numbers = figures(np.frombuffer(text, np.uint8)[starts[0] : e], [s - starts[0] for s in starts], usual)
            for s, then, row in zip(starts, [*starts[1:], e], numbers, strict=True):
                before = text[max(0, s - 60) : s]
                rule = bool(FORMATS.fullmatch(text, s, e)) or row[1] > 0 and bool(ASSIGNED.search(b := before.decode("utf-8", "ignore")) or LOGIN.search(b))
                mark = before.rstrip()[-1:]
                marks = [float(mark == m) for m in MARKS]
                own = sorted({w for w in words_of(text[s:then]) if 3 <= len(w) <= 12})
                yield s, e - s, int(rule), [*row.tolist(), *marks], words_of(before)[-3:], words_of(text[e : e + 40])[:1], own, path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [words_of(p.encode()) for p in b.column("source").to_pylist()]
            for c in texts(b.column("text")):
                starts, ends, _ = c.words(_RUN)
                long = np.flatnonzero(ends - starts >= LEAST)
                owner = np.searchsorted(c.offs, starts[long], "right") - 1
                runs: dict[int, list] = {}
                for k, s, e in zip(owner.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
                    runs.setdefault(k, []).append((s - int(c.offs[k]), e - int(c.offs[k])))
                out = [(c.first + k, *f) for k in range(c.n) for f in of(c.data[int(c.offs[k]) : int(c.offs[k + 1])].tobytes(), runs.get(k, []), paths[c.first + k])]
                who, *cols = zip(*out, strict=True) if out else [()] * 9
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(who, pa.int64())), *(pa.array(x, t) for x, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, {FOUND}")


def places(near: Column) -> Column:
    """place and distinct words of each place: next to the value, among the three before, after, inside, in the path."""
    return F.array(*[F.struct(F.lit(place).alias("place"), F.array_distinct(near if place == "near" else F.col(place)).alias("w")) for place in PLACES])


def nearest() -> Column:
    return F.array_compact(F.array(F.try_element_at("left", F.lit(-1))))


def vocabulary(labelled: DataFrame) -> dict[str, dict[str, float]]:
    """The log-odds that a finding with the word is a secret, for the words of each place that most labelled findings have."""
    rows = labelled.select("label", F.explode(places(nearest())).alias("x")).select("label", "x.place", F.explode("x.w").alias("word"))
    seen = rows.groupBy("place", "word").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("secret")).where(F.col("n") >= LEAST_SEEN)
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= MOST_WORDS)
    out: dict[str, dict[str, float]] = {place: {} for place in PLACES}
    for r in ranked.collect():
        out[r.place][r.word] = math.log((r.secret + 0.5) / (r.n - r.secret + 0.5))
    return out


def with_features(found: DataFrame, known: dict[str, dict[str, float]]) -> DataFrame:
    """Candidates with features: their numbers, and of each place the sum, least and greatest log-odds of its known words."""
    weights = []
    for place in PLACES:
        words = F.map_from_arrays(F.array(*map(F.lit, known[place])).cast("array<string>"), F.array(*map(F.lit, known[place].values())).cast("array<double>"))
        odds = known_odds(nearest() if place == "near" else F.array_distinct(F.col(place)), words)
        weights += [F.aggregate(odds, F.lit(0.0), lambda a, x: a + x), F.coalesce(F.array_min(odds), F.lit(0.0)), F.coalesce(F.array_max(odds), F.lit(0.0))]
    return found.withColumn("features", F.concat("numbers", F.array(*weights)))


def known_odds(words: Column, weights: Column) -> Column:
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(weights, w), F.lit(0.0)))


def training_findings(spark: SparkSession, counts: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Candidates that are labelled values of ``secret_findings`` with their labels, and all of the findings.

    Both have ``held_out``: crc32 of the number mod 5 is 0.
    """
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    made = materialise(labelled_findings(spark).select("*", held), "findings-made")
    values = made.select(F.col("doc_id").alias("v_id"), "v_start", "v_length", "label", "held_out")
    found = candidates(made.select("doc_id", "source", "text"), counts)
    same = (F.col("doc_id") == F.col("v_id")) & (F.col("start") == F.col("v_start")) & (F.col("length") == F.col("v_length"))
    return found.join(values, same).drop("v_id", "v_start", "v_length"), made


def fit(labelled: DataFrame, most: int = MAX_TRAIN):
    """A forest with its words from labelled candidates (doc_id, start, length, label, numbers, words), or the label they all have."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    part = lambda v: labelled.where(F.col("label") == v).orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start", "length").limit(most // 2)
    train = materialise(part(1.0).union(part(0.0)).select("label", "numbers", "left", "right", "own", "path"), "findings")
    seen = [r[0] for r in train.select("label").distinct().collect()]
    if len(seen) < 2:
        return seen[0] if seen else 0.0
    known = vocabulary(train)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="v", labelCol="label", probabilityCol="p")
    model = forest.fit(with_features(train, known).select("label", array_to_vector("features").alias("v")))
    drop(labelled.sparkSession, train)
    return model, known


def judged(found: DataFrame, model) -> DataFrame:
    """Candidates with the forest's probability."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if isinstance(model, float):
        return found.withColumn("probability", F.lit(model))
    forest, known = model
    return forest.transform(with_features(found, known).withColumn("v", array_to_vector("features"))).withColumn("probability", vector_to_array("p")[1])


def scan(docs: DataFrame, findings: DataFrame | None = None, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, start, length, probability, is_secret, by_rule of every candidate in docs(doc_id, source, text)."""
    counts = dictionary(docs)
    found = materialise(candidates(docs, counts), "candidates")
    if findings is None:
        made, _ = training_findings(docs.sparkSession, counts)
        labelled = made.where("not held_out")
    else:
        labelled = found.join(findings.select("doc_id", "start", F.col("label").cast("double").alias("label")), ["doc_id", "start"])
    scored = judged(found, fit(labelled, most))
    return scored.select("doc_id", "start", "length", "probability", (F.col("probability") >= 0.5).alias("is_secret"), (F.col("rule") == 1).alias("by_rule"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
