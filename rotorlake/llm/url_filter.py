"""Operator 9: URL allow and block lists as a trie over reversed host labels, then path segments.

A rule is ``host/path``; it fits its host and every subdomain when the URL's path starts with the
rule's path.  The longest rule wins, by the length of its text; of equally long ones that with more host labels.  The trie is broadcast with the task only while the rules' text is within
``max_trie_bytes``; a longer list is matched by equi-joins on (host suffix, path prefix) instead.

Null URLs, and URLs without ``://``, have empty host and path and fit no rule; no rule means the
default verdict ``allow``.  URLs of any length are judged whole.  No other ties occur: a rule listed twice keeps its last entry, ``block``
before ``allow`` on equal text.  Repeated rows are judged one by one; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from .common import read

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEFAULT = "allow"
MAX_TRIE_BYTES = 32 << 20

HOST = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


class Trie:
    """Nodes are dicts: by label down the reversed host, then under the key ``PATHS`` by path segment."""

    PATHS, HERE = "/", ""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for rule, verdict in sorted(rules, key=lambda r: r[1]):
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("." + label, {})
            node = node.setdefault(self.PATHS, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            # the last piece need not end with its segment: rules by its text
            node.setdefault(self.HERE, {})[last] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        found, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("." + label)
            if node is None:
                break
            if self.PATHS in node:
                here = self._path(node[self.PATHS], segments)
                # the longest rule wins, whether by its host or by its path; of equal ones that with more labels
                found = here if here and (not found or len(here[0]) >= len(found[0])) else found
        return found

    def _path(self, node: dict, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for k, segment in enumerate(segments):
            ends = node.get(self.HERE)
            if ends:
                fits = [p for p in ends if segment.startswith(p)]
                if fits:
                    found = ends[max(fits, key=len)]
            if k + 1 == len(segments):
                break
            node = node.get("/" + segment)
            if node is None:
                break
        return found


def parts(urls: DataFrame) -> DataFrame:
    """Adds host (lower-cased A-Z) and path; newlines count as any other character."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return urls.withColumns({"host": F.translate(host, upper, upper.lower()), "path": path})


def judge(urls: DataFrame, rules=RULES, default: str = DEFAULT, max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """url table with host, path, rule (null if none) and verdict; a column of these names is replaced."""
    rules = list(rules)
    kept = urls.drop("host", "path", "rule", "verdict")
    if sum(len(r) + len(v) for r, v in rules) > max_trie_bytes:
        return judge_by_join(kept, urls.sparkSession.createDataFrame(rules, "rule string, verdict string"), default)
    trie = Trie(rules)
    shape = parts(kept)
    schema = pa.schema([("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            hits = [trie.find(h, p) for h, p in zip(cols["host"].to_pylist(), cols["path"].to_pylist())]
            new = pa.RecordBatch.from_arrays([pa.array([h and h[0] for h in hits], pa.string()), pa.array([h[1] if h else default for h in hits], pa.string())], schema=schema)
            yield pa.RecordBatch.from_arrays([*cols.values(), *new.columns], names=[*cols, "rule", "verdict"])

    return shape.mapInArrow(run, T.StructType([*shape.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))


def judge_by_join(urls: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The same verdicts for rule lists too long to broadcast: rules(rule, verdict) joined on host suffix."""
    names = urls.columns
    rows = parts(urls).withColumn("row_no", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    rule_host = F.substring_index("rule", "/", 1)
    spread = rules.groupBy("rule").agg(F.max("verdict").alias("rule_verdict")).select("rule", "rule_verdict", rule_host.alias("suffix"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"))
    hits = (
        rows.select("row_no", "path", F.explode(suffixes).alias("suffix"))
        .join(spread, "suffix")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("row_no")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.size(F.split("suffix", r"\.")).alias("labels"), "rule", "rule_verdict")).alias("best"))
    )
    return rows.join(hits, "row_no", "left").select(*names, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH p AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rule, rhost, rpath, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
      FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT q.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict FROM q LEFT JOIN m ON q.page_id = m.page_id
"""
