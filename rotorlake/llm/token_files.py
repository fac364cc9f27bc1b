"""Operator 6: token ids in binary files of patched frame-of-reference blocks.

One file per range of ids, in ascending doc_id order::

    b"PFOR1\\n"
    blocks     each: minimum u32, n u16, width u8, exceptions u16, packed (id - minimum) at ``width``
               bits, exception places u16 each, exception values u32 each
    documents  doc_id i64 each, then tokens u32 each
    index      byte offset u64 of every block's start
    footer     n_blocks u64, n_docs u64, n_tokens u64, documents offset u64

A block holds ``BLOCK`` ids (the last one fewer).  Its width is the bit length of the ``PERCENTILE``-th
percentile of the differences, unless a wider one makes the block smaller; wider differences keep their
low bits in place and stand whole in the exception list.

Files hold about ``FILE_BYTES`` of text each, though at least ``spark.sql.shuffle.partitions`` files are made, and at
most ``MOST_FILES``.  An id that fills several ranges is cut further by hash of its rows' ids.

Null texts count as empty: they hold the end id alone; very long texts are encoded whole.  Rows with equal doc_id
are all kept, ordered by the crc32 of their ids; null ids come first and are written as the smallest 64-bit integer.
Extra columns are ignored, whatever their names.  An empty table gives no file and an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import materialise, new_folder, read, text_batches
from .files import open_fs, written

MAGIC = b"PFOR1\n"
BLOCK = 4096
PERCENTILE = 90
END_ID = 2
NULL_ID = -(1 << 63)
#: Pieces of text whose ids a worker remembers in each of two generations (about 80 MB each when full).
MEMO = 400_000
#: Bytes of text that are tokenised at a time.
STEP = 4 << 20
#: Text in a file, and the most files.
FILE_BYTES, MOST_FILES = 256 << 20, 16_384


#: Letters, digits and white space among the first 592 code points; the same in all versions of Unicode.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"


class Memo(dict):
    """Ids of pieces as little-endian u16 (u32 for large vocabularies); two generations of bounded size."""

    def __init__(self, model, kind: str):
        self.model, self.kind, self.old = model, kind, {}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        # byte-level vocabularies write each byte as one visible character
        self.visible = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}
        self.visible_space = chr(self.visible[32])

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            plain = piece.isascii() and piece.isprintable()
            found = self.model.tokenize(piece.replace(" ", self.visible_space) if plain else piece.encode().decode("latin-1").translate(self.visible))
            ids = np.array([t.id for t in found], self.kind).tobytes()
        self[piece] = ids
        return ids


class Encoder:
    """Token ids of whole texts with the tokenizers library, which is asked once for each piece it remembers.

    The byte-level pre-tokeniser cuts a text into pieces that the model encodes one by one.  Texts of the code
    points up to U+024F are cut here by the same rule, written with the classes above; all other texts, texts that
    hold the string of a special token, and all texts of tokenizers of another kind, go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        before, model = shape["pre_tokenizer"] or {}, shape["model"]
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.by_piece = bool(byte_level and plain and not shape["normalizer"] and not shape["truncation"] and not shape["padding"])
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.special, self.beyond = special, re.compile("[\u0250-\U0010ffff]")
        self.cut = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
        self.memo = Memo(self.tokenizer.model, self.kind)

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian, of the type ``kind``."""
        if not self.by_piece or not text.isascii() and self.beyond.search(text) or any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.memo.__getitem__, self.cut.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; it stays between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, lowest bit first."""
    if not width:
        return b""
    size = 2 if width <= 16 else 4
    bits = np.unpackbits(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    size = 2 if width <= 16 else 4
    full = np.zeros((n, 8 * size), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view(f"<u{size}").reshape(n).astype(np.uint32)


def encode_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    low = int(ids.min())
    diff = (ids - np.uint32(low)).astype(np.uint32)
    place = -(-(len(diff) - 1) * percentile // 100)
    chosen = int(np.partition(diff, place)[place]).bit_length()
    # bytes by width: packed bits plus six for each exception
    wide = np.bincount(np.frexp(diff.astype(np.float64))[1], minlength=33)
    over = np.cumsum(wide[::-1])[::-1]
    cost = {w: (len(ids) * w + 7) // 8 + 6 * int(over[w + 1] if w < 32 else 0) for w in range(chosen, 33)}
    width = min(cost, key=lambda w: (cost[w], w))
    at = np.flatnonzero(diff >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    return struct.pack("<IHBH", low, len(ids), width, len(at)) + pack(diff, width) + at.astype("<u2").tobytes() + diff[at].astype("<u4").tobytes()


def decode_block(data: bytes, at: int = 0) -> np.ndarray:
    low, n, width, n_out = struct.unpack_from("<IHBH", data, at)
    at += 9
    size = (n * width + 7) // 8
    diff = unpack(np.frombuffer(data, np.uint8, size, at), n, width)
    at += size
    where = np.frombuffer(data, "<u2", n_out, at)
    diff[where] = np.frombuffer(data, "<u4", n_out, at + 2 * n_out)
    return diff + np.uint32(low)


class Writer:
    def __init__(self, out):
        self.out, self.at, self.tokens = out, len(MAGIC), 0
        self.index, self.docs, self.sizes = array("q"), array("q"), array("I")
        self.left: list[np.ndarray] = []
        self.n_left = 0
        out.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.tokens += len(ids)
        self.left.append(ids)
        self.n_left += len(ids)
        if self.n_left >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.left) if self.left else np.zeros(0, np.uint32)
        to = len(ids) if last else len(ids) // BLOCK * BLOCK
        for a in range(0, to, BLOCK):
            block = encode_block(ids[a : min(a + BLOCK, to)])
            self.index.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.left, self.n_left = [ids[to:]], len(ids) - to

    def close(self) -> None:
        self._flush(True)
        docs = np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<u4").tobytes()
        self.out.write(docs + np.array(self.index, "<u8").tobytes() + struct.pack("<4Q", len(self.index), len(self.docs), self.tokens, self.at))


class Reader:
    """Reads a file's documents in order, or the ids of a range through the block index."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 32)
        n_blocks, n_docs, self.n_tokens, self.end = struct.unpack("<4Q", source.read(32))
        source.seek(self.end)
        tail = source.read(12 * n_docs + 8 * n_blocks)
        self.docs = np.frombuffer(tail, "<i8", n_docs)
        self.sizes = np.frombuffer(tail, "<u4", n_docs, 8 * n_docs).astype(np.int64)
        self.index = np.append(np.frombuffer(tail, "<u8", n_blocks, 12 * n_docs), np.uint64(self.end)).astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the file's start-th on; reads only the blocks that hold them."""
        if not n:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (start + n - 1) // BLOCK + 1
        self.source.seek(int(self.index[a]))
        data = self.source.read(int(self.index[b] - self.index[a]))
        base = self.index[a]
        ids = np.concatenate([decode_block(data, int(x - base)) for x in self.index[a:b]])
        return ids[start - a * BLOCK : start - a * BLOCK + n]

    def documents(self, step: int = 256 * BLOCK) -> Iterator[tuple[int, np.ndarray]]:
        ends = np.cumsum(self.sizes)
        k = 0
        while k < len(self.docs):
            begin = int(ends[k] - self.sizes[k])
            to = max(k + 1, int(np.searchsorted(ends, begin + step, "right")))
            ids = self.ids(begin, int(ends[to - 1]) - begin)
            for i in range(k, to):
                yield int(self.docs[i]), ids[int(ends[i] - self.sizes[i]) - begin : int(ends[i]) - begin]
            k = to


def ranges(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of files, and the ids that bound them.

    Bounds come from the ids alone: a range partitioner would tokenise everything once more to sample it.
    """
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, min(MOST_FILES, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // FILE_BYTES))))
    marks = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], max(10_000, 10 * n))).head()[0]
    return n, np.array(marks[: n - 1] if marks else [], np.int64)


def part_of(ids: np.ndarray, tie: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The file of each row; an id that is several bounds is spread over their files by ``tie``, in its order."""
    low = np.searchsorted(bounds, ids, "left")
    room = np.maximum(1, np.searchsorted(bounds, ids, "right") - low)
    return (low + (tie * room >> 32)).astype(np.int32)


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Tokenise docs(doc_id, text) into ``folder``; returns the manifest: part, path, n_docs, n_tokens.

    Texts are tokenised where they lie and only packed ids are dealt by id range, so the shuffle moves about
    half of the bytes of the text.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        end = np.array([end_id], e.kind).tobytes()
        for b in batches:
            texts, doc_ids, at = b.column("text"), b.column("doc_id"), 0
            sizes = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64))
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP, "right")))
                ids = [e.encode(t or "") + end for t in texts.slice(at, to - at).to_pylist()]
                own, tie = doc_ids.slice(at, to - at), np.array([zlib.crc32(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([own, pa.array(tie), pa.array(ids, pa.binary()), pa.array([e.kind] * len(ids)), pa.array(part_of(own.to_numpy(), tie, bounds))], names=["doc_id", "tie", "ids", "kind", "part"])
                at = to

    n, bounds = ranges(rows)
    tokenised = rows.mapInArrow(tokenise, "doc_id long, tie long, ids binary, kind string, part int")
    dealt = tokenised.repartitionById(n, F.col("part")).sortWithinPartitions("doc_id", "tie").drop("part")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.pfor"
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        with written(path) as out:
            w = Writer(out)
            while head is not None:
                for doc_id, raw, kind in zip(head.column("doc_id").to_pylist(), head.column("ids"), head.column("kind").to_pylist()):
                    w.add(doc_id, np.frombuffer(raw.as_buffer(), kind).astype(np.uint32))
                head = next(batches, None)
            w.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": len(w.docs), "n_tokens": w.tokens}], schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return materialise(dealt.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "token-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest."""
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "path", before.cast("long").alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                store, path = open_fs(row["path"])
                with store.open_input_file(path) as source:
                    reader, start, out = Reader(source, source.size()), row["start"], []
                    for doc_id, ids in reader.documents():
                        out.append((None if doc_id == NULL_ID else doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                        start += len(ids)
                        if len(out) == 20_000:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    n = max(1, manifest.count())
    return files.repartition(n, "part").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def tokens(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return read_files(write_files(docs, new_folder(docs.sparkSession, "tokens"), tokenizer_path))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(read(spark, sf_dir, "documents"))
