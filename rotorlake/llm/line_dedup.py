"""Operator 12: duplicate lines by levelled, sorted runs of line hashes; DataFrame functions only.

A line's key is the line without ``WHITE`` at both ends, A-Z lower-cased; a key is told by two 64-bit hashes.  A run is a
Parquet table of distinct keys (``h1, h2, docs, newest``: documents that hold the key, their largest id), bucketed and
sorted by the hashes, so that merging and joining runs moves none of their rows.  A new batch is aggregated to distinct
keys, merge-joined with every run, and only keys whose verdict it can change go into its own run: those that fewer than
``min_docs`` documents hold so far, and those with a larger id than before.  Two runs of one level are merged into one of
the next.  At the end the runs' frequent keys are joined with the lines, which Spark may split where a key
is hot (a third of all lines may be one line), and positions of lost lines go back to their texts.

Documents are rows: rows of equal id count separately and, if that id is the largest, all keep the line.  A null id is
smaller than any other.  A null or empty text is one empty line.  A line that repeats within a text counts once.  Ties
(equal largest ids) keep all their lines.  A text of any length is cut, filtered and joined in linear time.  An empty
table gives no rows; extra columns are never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialise, new_folder, read

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_POINTS, MIN_DOCS = 20, 3
#: Batches that ``dedup`` cuts a table into, by falling doc_id; more cost one pass over the runs each.
BATCHES = 6
KEY = ["h1", "h2"]


class LineRuns:
    """Runs of line keys in a folder of the shared store, a level holding at most one between batches; a manifest names those that count."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, min_docs: int = MIN_DOCS):
        self.spark, self.folder = spark, folder or new_folder(spark, "runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.min_docs = min_docs
        self.levels: list[list[str]] = [[]]

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The runs as the last finished ``add`` left them; what an interrupted one wrote is ignored."""
        state = json.loads(spark.read.text(f"{folder}/manifest-*", wholetext=True).select(F.input_file_name().alias("file"), "value").orderBy(F.desc("file")).first().value)
        out = cls(spark, folder, state["buckets"], state["min_docs"])
        out.levels = state["levels"]
        for name in (n for level in out.levels for n in level):
            if not spark.catalog.tableExists(name):
                spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, docs BIGINT, newest BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {out.buckets} BUCKETS LOCATION '{folder}/{name}'")
        return out

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex[:16]}"
        keys.select(*KEY, "docs", "newest").write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _merged(self, one: str, other: str) -> DataFrame:
        # a merge join of two runs in the same buckets; a union of bucketed tables gives wrong sums in Spark 4.1
        more = self.spark.table(other).select(*KEY, F.col("docs").alias("d2"), F.col("newest").alias("n2"))
        rows = self.spark.table(one).join(more, KEY, "full")
        return rows.select(*KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("d2", F.lit(0))).alias("docs"), F.greatest("newest", "n2").alias("newest"))

    def _forget(self, names: list[str]) -> None:
        for name in names:
            table = self.spark.table(name)
            self.spark.sql(f"DROP TABLE {name}")
            drop(self.spark, table)

    def _commit(self) -> None:
        """Write the next manifest; its number grows, so the last whole one is the state."""
        state = {"buckets": self.buckets, "min_docs": self.min_docs, "levels": self.levels}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        store = at.getFileSystem(conf)
        number = sum(f.getPath().getName().startswith("manifest-") for f in store.listStatus(at))
        part = jvm.org.apache.hadoop.fs.Path(at, f"part-{uuid.uuid4().hex[:8]}.tmp")
        out = store.create(part)
        out.write(json.dumps(state).encode())
        out.close()
        store.rename(part, jvm.org.apache.hadoop.fs.Path(at, f"manifest-{number:09d}"))

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """h1, h2, docs, newest of a batch's lines(h1, h2, doc_id), without keys whose verdict the runs have settled."""
        keys = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("newest"))
        before, latest = F.lit(0), F.lit(None).cast("long")
        for i, name in enumerate(self.names()):
            run = self.spark.table(name).select(*KEY, F.col("docs").alias(f"d{i}"), F.col("newest").alias(f"n{i}"))
            keys = keys.join(run, KEY, "left")
            before, latest = before + F.coalesce(f"d{i}", F.lit(0)), F.greatest(latest, F.col(f"n{i}"))
        return keys.where((before < self.min_docs) | F.col("newest").isNotNull() & (latest.isNull() | (F.col("newest") > latest))).select(*KEY, "docs", "newest")

    def add(self, lines: DataFrame) -> None:
        """Add a batch: lines(h1, h2, doc_id), one row for each document and key."""
        self.levels[0].append(self._write(self.unsettled(lines)))
        old, level = [], 0
        while len(self.levels[level]) == 2:
            merged = self._write(self._merged(*self.levels[level]))
            old += self.levels[level]
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1
        self._commit()
        self._forget(old)

    def compact(self) -> None:
        """Merge all runs into one, smallest first."""
        names = self.names()
        if len(names) > 1:
            now = names[0]
            for name in names[1:]:
                last, now = now, self._write(self._merged(now, name))
                if last not in names:
                    self._forget([last])
            self.levels = [[] for _ in self.levels[:-1]] + [[now]]
            self._commit()
            self._forget(names)

    def frequent(self) -> DataFrame:
        """h1, h2, newest of keys that at least ``min_docs`` documents hold."""
        self.compact()
        return self.spark.table(self.names()[0]).where(F.col("docs") >= self.min_docs).select(*KEY, "newest")

    def clear(self) -> None:
        self._forget(self.names())
        self.levels = [[]]


def cut() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def text_key() -> Column:
    return F.xxhash64("text").alias("t1")


def long_lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """doc_id, t1 (hash of the text), h1, h2, pos, first (whether no earlier place of the text has the key) of lines with long keys."""
    keys = F.transform(F.split(F.translate("text", UPPER, LOWER), "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)))
    found = F.filter(F.transform(keys, lambda k, i: F.struct(F.when(F.length(k) >= min_points, F.xxhash64(k)).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2"), i.alias("pos"))), lambda x: x["h1"].isNotNull())
    # equal keys stand together once sorted; the array is bound once, not worked out again for every element
    told = F.transform(F.array(F.sort_array(found)), lambda s: F.transform(s, lambda x, i: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), ((i == 0) | ~x["h1"].eqNullSafe(s[F.greatest(i - 1, F.lit(0))]["h1"]) | ~x["h2"].eqNullSafe(s[F.greatest(i - 1, F.lit(0))]["h2"])).alias("first"))))
    return docs.select("doc_id", text_key(), F.explode(told[0]).alias("x")).select("doc_id", "t1", "x.*")


def lost_places(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, t1, places: positions of the lines that each text loses; texts that lose none are left out."""
    spark = docs.sparkSession
    # newest first: a key that enough documents hold is settled for all later batches
    bounds = docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = sum((F.coalesce(F.col("doc_id") <= F.lit(int(b)), F.lit(True)).cast("int") for b in bounds), F.lit(0))
    path = new_folder(spark, "lines")
    long_lines(docs, min_points).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, t1 long, h1 long, h2 long, pos int, first boolean, batch int").parquet(path)
    runs = LineRuns(spark, min_docs=min_docs)
    for b in range(batches):
        runs.add(lines.where((F.col("batch") == b) & F.col("first")))
    frequent = materialise(runs.frequent(), "frequent")
    runs.clear()
    lost = lines.join(frequent, KEY).where(F.col("newest").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("newest"))))
    # rows equal in id and text lose the same places
    out = materialise(lost.groupBy("doc_id", "t1").agg(F.collect_set("pos").alias("places")), "lost")
    drop(spark, lines, frequent)
    return out


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without its lost lines, null if it loses all) of every row of docs(doc_id, text)."""
    lost = lost_places(docs, min_points, min_docs, batches).select(F.col("doc_id").alias("k_doc_id"), F.col("t1").alias("k_t1"), "places")
    own = docs.select("doc_id", "text", text_key())
    rows = own.join(lost, F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & (F.col("t1") == F.col("k_t1")), "left")
    lines = F.transform(F.array(cut()), lambda x: F.when(F.col("places").isNull(), x).otherwise(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("places")), lambda i: x[i])))[0]
    rows = rows.select("doc_id", F.size(cut()).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(lines, "\n").alias("kept"))
    return rows.withColumn("kept", F.when(F.col("n_dropped") < F.col("n_lines"), F.col("kept")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: all documents with their lines counted and the digest of what stays."""
    rows = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k, max(doc_id) AS newest FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
told AS (SELECT r, pos, line, coalesce(newest IS NOT NULL AND (doc_id IS NULL OR doc_id < newest), false) AS lost FROM keyed LEFT JOIN often USING (k)),
sums AS (SELECT r, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '') AS kept FROM told GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM docs JOIN sums USING (r)
"""
