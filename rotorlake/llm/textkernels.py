"""Vectorised NumPy helpers over the texts of Arrow batches.

Texts stay in Arrow's own UTF-8 buffer and are worked on in chunks of about
``CHUNK_BYTES`` (a longer text makes a chunk of its own), so memory is bounded
by the longest text and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20

_U = np.uint64

SPACE_BYTES = b" \t\n\x0b\x0c\r"

#: True for bytes of words ``[^\x20\x09-\x0D]+``.
NON_SPACE = np.ones(256, bool)
NON_SPACE[list(SPACE_BYTES)] = False

#: True for bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective) for arrays of uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Longest span that is hashed word by word; longer ones go to a hash of the xxhash library one at a time.
LONG_SPAN = 256
_START = _U(0x9E3779B97F4A7C15)
#: Keeps the low 0 to 8 bytes of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Chunk:
    """Consecutive texts of one batch: ``data`` bytes, ``offs`` of each text within them."""

    __slots__ = ("data", "offs", "first", "n")

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int):
        self.data, self.offs, self.first, self.n = data, offs, first, len(offs) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def words(self, table: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (bytes) of all words, and each text's first word's index (texts + 1 values)."""
        data = self.data if data is None else data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = table[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[self.offs] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        return starts, ends, np.searchsorted(starts, self.offs)


def texts(column: pa.Array, chunk_bytes: int | None = None) -> Iterator[Chunk]:
    """Chunks of a string column; null counts as the empty text."""
    chunk_bytes = chunk_bytes or CHUNK_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offs, offs[at] + chunk_bytes, "right")) - 1
        to = min(max(to, at + 1), len(column), at + 20_000)
        yield Chunk(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], at)
        at = to


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand.

    Eight bytes at a time go through ``mix``, which is not linear, so that no pattern of bytes cancels out: two
    different spans are equal with a chance of 2**-64.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", room, strides=(1,))
    out = mix(eight[starts] & _LOW[np.minimum(size, 8)] ^ mix(size.astype(np.uint64) + _START))
    more = np.flatnonzero(size > 8)
    if len(more):
        long = more[size[more] > LONG_SPAN]
        for k in long.tolist():
            out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
        more = more[size[more] <= LONG_SPAN]
        at, left, h = starts[more] + 8, size[more] - 8, out[more]
        while len(more):
            h = mix(h ^ eight[at] & _LOW[np.minimum(left, 8)])
            done = left <= 8
            if done.any():
                out[more[done]] = h[done]
                more, at, left, h = (x[~done] for x in (more, at, left, h))
            at, left = at + 8, left - 8
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and for each the index of its first word.

    ``first`` has each text's first word's index, with the total at the end; runs never cross texts.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * (mix(np.array([j + 1], np.uint64))[0] | _U(1))
    valid = np.ones(len(words), bool)
    for j in range(1, k):
        at = first[1:] - j
        valid[at[at >= first[:-1]]] = False
    at = np.flatnonzero(valid[:n])
    return mix(out[at]), at


def owners(first: np.ndarray, n: int) -> np.ndarray:
    """The text index of each of n words, from each text's first word's index."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
