"""Vectorised byte-level text work on Arrow columns: word bounds and word hashes of whole batches with numpy.

UTF-8 bytes of 0x80 and above belong to words in both word classes used here, so classes of single bytes
find the same words as the character classes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_BASE, BLOCK)
_INV = _powers(pow(_BASE, -1, 1 << 64), BLOCK)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOWER = np.frombuffer(LOWER, dtype=np.uint8)

#: Words of letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: Words of everything but ASCII white space.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a fresh array."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another and their n + 1 offsets from 0; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide:
        column = column.cast(pa.string()) if pa.types.is_string_view(column.type) else column
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about max_bytes of text; a longer text is a run by itself."""
    if batch.num_rows == 0:
        return
    _, offsets = buffer_of(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words, and the n + 1 places in them where each text's words begin."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    edge = np.empty(n + 1, dtype=bool)
    edge[0], edge[n] = inside[0], False
    np.logical_and(inside[1:], ~inside[:-1], out=edge[1:n])
    edge[cut] = inside[cut]
    starts = np.flatnonzero(edge[:n])
    edge[n] = inside[n - 1]
    edge[0] = False
    np.logical_and(inside[:-1], ~inside[1:], out=edge[1:n])
    cut = cut[cut > 0]
    edge[cut] = inside[cut - 1]
    ends = np.flatnonzero(edge)
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, A-Z as a-z. Polynomial over random byte values, by differences of running sums in blocks."""
    out = np.empty(len(starts), dtype=np.uint64)
    table = _BYTE[_LOWER] if lower else _BYTE
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            lo = starts[at]
            to = int(np.searchsorted(ends, lo + BLOCK, side="right"))
            if to <= at:  # one word longer than a block, in pieces
                h = np.uint64(0)
                for p in range(int(lo), int(ends[at]), BLOCK):
                    q = min(p + BLOCK, int(ends[at]))
                    h = h * np.uint64(0xD6E8FEB86659FD93) + (table[data[p:q]] * _POW[: q - p]).sum(dtype=np.uint64)
                out[at] = h
                at += 1
                continue
            values = table[data[lo : ends[to - 1]]]
            values *= _POW[: len(values)]
            sums = np.empty(len(values) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(values, out=sums[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * _INV[s]
            at = to
        out += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix(out)


def code_points(data: np.ndarray, at: np.ndarray | list[int]) -> np.ndarray:
    """Code points that lie before each byte position of one text."""
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return first[np.asarray(at, dtype=np.int64)]
