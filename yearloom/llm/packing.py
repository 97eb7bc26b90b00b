"""Packing along a space-filling curve: hashed document vectors in few dimensions, range-sorted by Hilbert key, cut into sequences."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded, tidied
from .text import ALNUM, buffer_of, hash_words, slices, words_of

DIMS, BITS, BUCKETS = 4, 12, 1024
#: Estimated input bytes for which a range partition is added beyond spark.sql.shuffle.partitions, and how many there may be.
PARTITION, MOST_PARTITIONS = 128 << 20, 500_000
SPECIAL = "<|endoftext|>"
#: A space behind what is no white space, and what other spaces are behind.
_CUT = re.compile(r" (?<=\S )")
_BEHIND = [" ", *(c for c in map(chr, range(0x3001)) if c != " " and c.isspace())]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (integers below 2 ** bits, one column a dimension) on the Hilbert curve through all of them."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_PROJECT = np.random.default_rng(11).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def curve_keys(text: pa.Array) -> pa.Array:
    """Hilbert key of each text: damped word counts in hashed buckets, scaled to length 1, projected to few dimensions."""
    out = []
    for batch in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text", 1 << 20):
        data, offsets = buffer_of(batch.column(0))
        starts, ends, first = words_of(data, offsets, ALNUM)
        n = batch.num_rows
        owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(first))
        bucket = (hash_words(data, starts, ends) >> np.uint64(54)).astype(np.int64)
        counts = np.bincount(owner * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
        vec = np.log1p(counts, dtype=np.float32)
        at = (vec @ _PROJECT) / np.maximum(np.sqrt((vec * vec).sum(axis=1)), 1e-9)[:, None]
        grid = ((np.tanh(at / 2) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
        out.append(hilbert(grid, BITS))
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))


class Ids(dict):
    """Ids of a text as little-endian unsigned 32-bit numbers, by the byte-level merges of a tokenizers file.

    Pieces that begin with a space behind no white space of any kind are looked up here and merged only when they
    are new: the pattern that cuts a text before merging always cuts there, and looks no further back.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, most: int = 250_000):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = np.array([len(ranks)], dtype="<u4").tobytes()
        self.most = most

    def merge(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(" " + piece)
        if len(piece) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids

    def ordinary(self, text: str) -> bytes:
        head, *rest = _CUT.split(text) if any(c + " " in text for c in _BEHIND) else text.split(" ")
        return self.merge(head) + b"".join(map(self.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return self.special.join(self.ordinary(x) if x else b"" for x in text.split(SPECIAL))
        return self.ordinary(text) if text else b""


_IDS: dict[tuple, Ids] = {}


class Packer:
    """Fills sequences of length tokens; the last, partial one is cut into powers of two, so that none is padded."""

    def __init__(self, partition: int, length: int):
        self.next, self.length, self.fill, self.open = partition << 32, length, 0, []

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        while at < total:
            n = min(total - at, self.length - self.fill)
            self.open.append((doc, at, n, ids[4 * at : 4 * (at + n)], total))
            self.fill += n
            at += n
            if self.fill == self.length:
                yield from self._close(self.open)
                self.open, self.fill = [], 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, n, ids, total in pieces:
            yield doc, start, n, zlib.crc32(ids), total, self.next, offset
            offset += n
        self.next += 1

    def end(self) -> Iterator[tuple]:
        rest, left = self.open[::-1], self.fill
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            own, room = [], size
            while room:
                doc, start, n, ids, total = rest.pop()
                k = min(n, room)
                own.append((doc, start, k, ids[: 4 * k], total))
                if k < n:
                    rest.append((doc, start + k, n - k, ids[4 * k :], total))
                room -= k
            yield from self._close(own)


def _pack(files: tuple[str, str, str], length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    if files not in _IDS:
        _IDS[files] = Ids(*files)
    ids, end = _IDS[files], b"\0\0\0\0"
    packer = Packer(TaskContext.get().partitionId(), length)
    kinds = [pa.int64()] * 7

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=[c.split()[0] for c in PIECES.split(", ")])

    for batch in batches:
        found: list[tuple] = []
        docs = batch.column("doc_id").to_pylist()
        for i, doc in enumerate(docs):
            found += packer.add(doc, ids.encode(batch.column("text")[i].as_py() or "") + end)
        if found:
            yield rows(found)
    if found := list(packer.end()):
        yield rows(found)


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, length: int = 1024, partitions: int | None = None) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; neighbours on the curve share sequences.

    Each row of docs (doc_id long, text string; other columns aren't read) gives its ids and an id 0; null and
    empty texts give just that id. Rows with equal doc_id, or none, stay separate documents. Documents are sorted by
    Hilbert key of their hashed word vector (ties, copies above all, by doc_id) over range partitions; each
    partition is one stream of ids cut every length tokens. What is left of it, under one sequence, is cut
    into sequences of powers of two, so nothing is padded. A document may be longer than any number of
    sequences. An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // PARTITION + 1, MOST_PARTITIONS))
    key = F.arrow_udf(curve_keys, "long")
    keyed = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("curve", key("text"))
    run = keyed.repartitionByRange(parts, "curve", "doc_id").sortWithinPartitions("curve", "doc_id").select("doc_id", "text")
    return run.mapInArrow(tidied(partial(_pack, (json_path, ranks_path, pattern), length)), PIECES)
