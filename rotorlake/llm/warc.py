"""Operator 5: WARC archives, normalised from one gzip stream per file to one member per record.

1. ``write_archives`` writes one record per row into archives that are a single gzip stream each.
   Of records with equal payloads of ``min_bytes`` or more the one with the largest page_id is the
   response and the others revisit it; the payload of a revisit is not stored again.
2. ``normalise`` inflates each archive once as a stream, holding one record at a time, rewrites every
   record as its own gzip member and writes a sidecar index (offset, length, id, type) beside it.
3. ``read_archives`` seeks each record by the sidecar, inflates that member alone and checks its digest.

Null html is the empty payload; null urls give an empty target; a null page_id is kept as null and never
the response if its group has another id.  Rows equal in page_id and payload count as the same response
if they carry the largest id.  Very long payloads are held one at a time.  Archives that end within a gzip member or
a record, or hold another number of records than their manifest says, are an error.  Extra columns are ignored,
whatever their names.  An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_folder, read
from .files import open_fs, written

ARCHIVE_BYTES = 64 << 20
STEP = 1 << 18
MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to given) names its response and stores no payload."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if revisit else payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


class Records:
    """Cuts a stream of bytes into whole records, holding no more than one record and one piece."""

    def __init__(self):
        self.left = bytearray()

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.left += piece
        at = 0
        while (cut := self.left.find(b"\r\n\r\n", at)) >= 0:
            head = parse_head(bytes(self.left[at:cut]))
            end = cut + 8 + int(head["Content-Length"])
            if end > len(self.left):
                break
            yield head, bytes(self.left[at:end])
            at = end
        del self.left[:at]


def parse_head(raw: bytes) -> dict[str, str]:
    version, *lines = raw.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_sha, refers_to of the rows that repeat another row's payload.

    Groups are made by aggregation of digests; only groups with several ids are joined back.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", F.sha1(F.encode(payload, "UTF-8")).alias("payload_sha"), F.octet_length(payload).alias("n"))
    groups = keyed.where(F.col("n") >= min_bytes).groupBy("payload_sha").agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("rows"))
    groups = materialise(groups.where("rows > 1").select("payload_sha", "last_id"), "payload-groups")
    return keyed.join(groups, "payload_sha").where("page_id < last_id or page_id is null").where("last_id is not null").select("page_id", "payload_sha", F.col("last_id").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) and returns the manifest: path, n_records, n_bytes (inflated)."""
    known = materialise(revisits(pages, min_bytes), "revisits").select(F.col("page_id").alias("r_id"), F.col("payload_sha").alias("r_sha"), "refers_to")
    rows = pages.select("page_id", "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("sha"))
    rows = rows.join(known, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, out = TaskContext.get().partitionId(), 0, None
        records = ((p, u or "", (h or "").encode(), r) for b in batches for p, u, h, r in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to"))))
        row = next(records, None)
        while row is not None:
            path, n, size = f"{folder}/raw-{part:06d}-{k:04d}.warc.gz", 0, 0
            with written(path) as out:
                gz = zlib.compressobj(6, wbits=31)
                while row is not None and size < archive_bytes:
                    raw = record(*row)
                    out.write(gz.compress(raw))
                    n, size, row = n + 1, size + len(raw), next(records, None)
                out.write(gz.flush())
            k += 1
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n, "n_bytes": size}], schema=MANIFEST)

    return materialise(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def each(manifest: DataFrame) -> DataFrame:
    """A manifest dealt out to about one task per file."""
    return manifest.repartition(max(1, manifest.count()))


def normalise(manifest: DataFrame) -> DataFrame:
    """Rewrites each archive with a member per record; returns path, index_path, n_records, n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, expected in zip(b.column("path").to_pylist(), b.column("n_records").to_pylist()):
                new = path.replace("/raw-", "/records-")
                index_path = new.removesuffix(".warc.gz") + ".index.jsonl"
                store, local = open_fs(path)
                at = n = 0
                with store.open_input_stream(local, compression=None) as source, written(new) as out, written(index_path) as index:
                    inflate, cut, whole = zlib.decompressobj(31), Records(), True
                    while piece := source.read(STEP):
                        while piece:
                            inflated, whole = inflate.decompress(piece, 4 * STEP), False
                            piece = inflate.unconsumed_tail
                            for head, raw in cut.feed(inflated):
                                gz = zlib.compressobj(6, wbits=31)
                                member = gz.compress(raw) + gz.flush()
                                out.write(member)
                                index.write((json.dumps({"offset": at, "length": len(member), "id": head["WARC-Record-ID"], "type": head["WARC-Type"]}) + "\n").encode())
                                at, n = at + len(member), n + 1
                            if inflate.eof:
                                # archives may hold several members all the same
                                piece, inflate, whole = inflate.unused_data, zlib.decompressobj(31), True
                    if cut.left or not whole:
                        raise ValueError(f"{path}: ends within a {'record' if cut.left else 'gzip member'}")
                    if n != expected:
                        raise ValueError(f"{path}: {n} records of {expected}")
                yield pa.RecordBatch.from_pylist([{"path": new, "index_path": index_path, "n_records": n, "n_bytes": at}], schema=pa.schema([("path", pa.string()), ("index_path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return materialise(each(manifest).mapInArrow(run, "path string, index_path string, n_records long, n_bytes long"), "normal-manifest")


def _page(text: str) -> int | None:
    number = text.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read by the sidecars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                store, path = open_fs(row["path"])
                _, index_path = open_fs(row["index_path"])
                with store.open_input_file(path) as source, store.open_input_stream(index_path, compression=None) as lines:
                    found, left = [], b""
                    while True:
                        piece = lines.read(STEP)
                        *whole, left = (left + piece).split(b"\n")
                        for line in whole:
                            entry = json.loads(line)
                            source.seek(entry["offset"])
                            raw = zlib.decompress(source.read(entry["length"]), 31)
                            cut = raw.index(b"\r\n\r\n")
                            head, body = parse_head(raw[:cut]), raw[cut + 4 : -4]
                            said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            if head["WARC-Type"] == "response" and (digest(body) != said or len(body) != int(head["WARC-Payload-Length"])):
                                raise ValueError(f"{row['path']}: damaged record at {entry['offset']}")
                            found.append((_page(head["WARC-Record-ID"]), int(head["WARC-Payload-Length"]), said, head["WARC-Type"], _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None))
                        if found and (len(found) >= 20_000 or not piece):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                            found = []
                        if not piece:
                            break

    return each(manifest).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), new_folder(spark, "warc"))
    return read_archives(normalise(raw))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last_id FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(p.h, (i // 8 * 10 + 1)::BIGINT, 10))::BIGINT >> ((7 - i % 8) * 5)::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM p JOIN g ON p.h = g.h
"""
