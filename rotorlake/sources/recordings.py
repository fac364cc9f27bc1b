"""Recordings as fixed chunks: a data source that reads byte ranges of WAV files, in batch or as a stream.

    spark.dataSource.register(Recordings)
    spark.read.format("recordings").option("chunk_s", 1.0).load("hdfs:///clips")          # or spark.readStream

A partition is a list of byte ranges; it reads headers and the samples of its own chunks, so a long recording spreads over
tasks and no row holds a file.  A chunk belongs to the range in which its last byte lies, the last partial one to the range
with the end of the file.  As a stream, an offset is a byte of each file: chunks come out as they are
whole, the partial one once the file holds all that its header claims.  The offset names every file, so a streamed folder should hold
recordings of days, not of years.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.dsp import BadAudio

SCHEMA = "path string, chunk_no long, rate int, samples array<float>, error string"
ARROW = pa.schema([("path", pa.string()), ("chunk_no", pa.int64()), ("rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])
#: Bytes that a partition takes, and samples that a batch of rows holds, about.
PARTITION_BYTES, BATCH_SAMPLES = 64 << 20, 1 << 20
#: Bytes after which a growing file without a good header is an error.
HEAD = 1 << 16


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path or uri
    return fs.FileSystem.from_uri(uri)


def listed(root: str) -> dict[str, int]:
    """Path and size of the WAV files under a folder (or of one file), by name; no byte of them is read."""
    store, path = opened(root)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
    return {f.path: f.size for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.lower().endswith(".wav")}


def header(file) -> tuple[int, int, int, int]:
    """Channels, rate, first byte of the samples, bytes that the header claims for them."""
    if file.size() < 12 or (head := file.read_at(12, 0))[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise BadAudio("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= file.size():
        name, size = struct.unpack("<4sI", file.read_at(8, at))
        if name == b"fmt ":
            body = file.read_at(min(size, 40), at + 8)
            if len(body) < 16:
                raise BadAudio("short format chunk")
            fmt = struct.unpack_from("<HHIIHH", body)
            kind = struct.unpack_from("<H", body, 24)[0] if fmt[0] == 0xFFFE and len(body) >= 26 else fmt[0]
            if kind != 1 or fmt[5] != 16 or not fmt[1]:
                raise BadAudio("not 16-bit PCM")
        elif name == b"data":
            if fmt is None:
                raise BadAudio("data before format")
            return fmt[1], fmt[2], at + 8, size
        at += 8 + size + size % 2
    raise BadAudio("no data chunk")


class Ranges(InputPartition):
    """Byte ranges (path, from, to) of files; ``closed`` tells that the files are complete as they are."""

    def __init__(self, ranges: list[tuple[str, int, int]], closed: bool):
        self.ranges, self.closed = ranges, closed


def dealt(ranges: list[tuple[str, int, int]], closed: bool, most: int) -> list[Ranges]:
    """Ranges cut at ``most`` bytes and packed to partitions of about that many."""
    out, now, held = [], [], 0
    for path, a, z in ranges:
        while True:
            cut = min(z, a + most - held)
            now.append((path, a, cut))
            held += cut - a
            if held >= most:
                out.append(Ranges(now, closed))
                now, held = [], 0
            a = cut
            if a >= z:
                break
    return out + ([Ranges(now, closed)] if now else [])


def chunks(store: fs.FileSystem, path: str, a: int, z: int, closed: bool, seconds: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """Number, rate and samples (first channel) of the chunks whose last byte lies in (a, z]."""
    with store.open_input_file(path) as file:
        channels, rate, first, claimed = header(file)
        frame = 2 * channels
        size = max(1, int(seconds * rate)) * frame
        there = min(claimed, max(0, file.size() - first)) if closed else min(claimed, max(0, z - first))
        there -= there % frame
        k = max(0, (a - first) // size)
        while k * size < there:
            end = min((k + 1) * size, there)
            whole = end == (k + 1) * size
            # the last byte of a partial chunk stands for the end of the file, whatever follows the samples
            last = first + end if whole else (file.size() if closed else first + claimed)
            if last > z:
                return
            if last > a:
                x = np.frombuffer(file.read_at(end - k * size, first + k * size), "<i2").reshape(-1, channels)[:, 0]
                yield k, rate, x.astype(np.float32) / 32768
            k += 1


def rows(root: str, part: Ranges, seconds: float) -> Iterator[pa.RecordBatch]:
    store, _ = opened(root)
    held: list[tuple] = []
    total = 0
    for path, a, z in part.ranges:
        try:
            for k, rate, x in chunks(store, path, a, z, part.closed, seconds):
                held.append((path, k, rate, x, None))
                total += len(x)
                if total >= BATCH_SAMPLES:
                    yield batch(held)
                    held, total = [], 0
        except BadAudio as e:
            # told once: with a complete file's first byte, or when a growing one should have its header
            if a == 0 if part.closed else a < HEAD <= z:
                held.append((path, None, None, None, str(e)))
    if held:
        yield batch(held)


def batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), ARROW.types, strict=True)], schema=ARROW)


class Recordings(DataSource):
    """Format ``recordings``; options: path, chunk_s (1.0), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)

    def streamReader(self, schema) -> RecordingStream:
        return RecordingStream(self.options)


class RecordingReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.seconds, self.most = options["path"], float(options.get("chunk_s", 1.0)), int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[Ranges]:
        return dealt([(p, 0, n) for p, n in listed(self.root).items()], True, self.most) or [Ranges([], True)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return rows(self.root, partition, self.seconds)


class RecordingStream(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.seconds, self.most = options["path"], float(options.get("chunk_s", 1.0)), int(options.get("partition_bytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(listed(self.root))}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return dealt([(p, before.get(p, 0), n) for p, n in now.items() if n > before.get(p, 0)], False, self.most) or [Ranges([], False)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return rows(self.root, partition, self.seconds)

    def commit(self, end: dict) -> None:
        pass
