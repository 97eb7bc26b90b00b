"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded, tidied, write_table
from .text import NONSPACE, buffer_of, hash_words, slices, words_of
from .training import labelled, remainder

#: Buckets of byte trigrams and of trigrams of character kinds; measures of form; kept dimensions; voting neighbours.
RAW, KIND, FORM, LATENT, VOTERS = 1024, 1024, 6, 64, 15
#: Labelled documents whose votes are looked at first, so that most others needn't be.
SEEDS = 4096
#: Features of a text; rows of a block of their products.
SIZE, BLOCK = RAW + KIND + FORM, 128

_KIND = np.arange(256, dtype=np.uint32)
_KIND[0x61:0x7B] = _KIND[0x80:] = 0x61
_KIND[0x41:0x5B] = 0x41
_KIND[0x30:0x3A] = 0x30
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_OTHER = ~_LETTER
_OTHER[[0x20, 0x0A, 0x2C, 0x2E]] = False


def _trigrams(codes: np.ndarray, bits: int) -> np.ndarray:
    h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of damped trigram counts, each group scaled to length 1, and of measures of form, for whole texts."""
    n = len(offsets) - 1
    out = np.zeros((n, RAW + KIND + FORM), dtype=np.float32)
    if len(data) >= 3:
        owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
        same = owner[:-2] == owner[2:]
        for codes, width, at in ((data.astype(np.uint32), RAW, 0), (_KIND[data], KIND, RAW)):
            slot = owner[:-2] * width + _trigrams(codes, width.bit_length() - 1)
            counts = np.bincount(slot[same], minlength=n * width).reshape(n, width)
            group = np.log1p(counts, dtype=np.float32)
            out[:, at : at + width] = group / np.maximum(np.sqrt((group * group).sum(axis=1, keepdims=True)), 1e-9)
    size = np.maximum(np.diff(offsets), 1)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    starts, ends, first = words_of(data, offsets, NONSPACE)
    h = hash_words(data, starts, ends)
    words = np.maximum(np.diff(first), 1)
    again = np.zeros(len(h) + 1, dtype=np.int64)
    if len(h) > 1:
        equal = h[1:] == h[:-1]
        cut = first[1:-1]
        equal[cut[(cut > 0) & (cut < len(h))] - 1] = False
        again[2:] = np.cumsum(equal)
    form = np.stack(
        [
            (again[first[1:]] - again[np.minimum(first[:-1] + 1, first[1:])]) / words,
            per_text(_UPPER[data]) / np.maximum(per_text(_LETTER[data]), 1),
            per_text(_OTHER[data]) / size,
            per_text(data == 0x0A) / words,
            per_text(data == 0x2E) / words,
            size / words / 20,
        ],
        axis=1,
    )
    out[:, RAW + KIND :] = np.clip(form, 0, 2)
    return out


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the documents of a task: sums of products of features, in blocks of rows from the diagonal on, and as the last block the sums of features and the number of documents."""
    product, sums, n, first = None, np.zeros(SIZE), 0, 0
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            x = features(*buffer_of(batch.column("text")))
            if product is None:
                product, first = np.zeros((SIZE, SIZE)), batch.column("doc_id")[0].as_py()
            product += x.T @ x
            sums += x.sum(axis=0, dtype=np.float64)
            n += len(x)
    if product is not None:
        for block, at in enumerate(range(0, SIZE, BLOCK)):
            yield _block(first, block, product[at : at + BLOCK, at:].astype(np.float32))
        yield _block(first, block + 1, np.append(sums, n))


def _block(first: int, block: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["first", "block", "part"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the parts of each block, which stand together."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist()):
            own = np.frombuffer(part, np.float32 if block * BLOCK < SIZE else np.float64)
            total[block] = total.get(block, 0.0) + own.astype(np.float64)
    for block, own in total.items():
        yield _block(0, block, own)


class Latent:
    """The latent space of documents, from their number, the sums of their features and the sums of products."""

    def __init__(self, n: int, sums: np.ndarray, product: np.ndarray):
        self.mean = (sums / max(1, n)).astype(np.float32)
        self.axes = np.zeros((SIZE, 1), np.float32)
        if n:
            spread = product - np.outer(sums, sums) / n
            rng = np.random.default_rng(3)
            basis = spread @ rng.standard_normal((SIZE, LATENT + 16))
            for _ in range(10):
                basis = spread @ np.linalg.qr(basis)[0]
            q = np.linalg.qr(basis)[0]
            power, turn = np.linalg.eigh(q.T @ spread @ q)
            power, turn = power[::-1][:LATENT], turn[:, ::-1][:, :LATENT]
            # directions that hold no more than rounding are none
            if (real := power > 1e-6 * max(power[0], 1e-9 * n)).any():
                self.axes = (q @ turn[:, real]).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.axes - self.mean @ self.axes
        return z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-9)


def latent(known: DataFrame) -> Latent:
    """The latent space of all of known (doc_id, text): tasks add up products, and the sums alone (18 MB) come to the driver."""
    parts = known.select("doc_id", "text").mapInArrow(tidied(_products), "first long, block int, part binary").repartition(-(-SIZE // BLOCK) + 1, "block")
    found = {r.block: r.part for r in parts.sortWithinPartitions("block", "first").mapInArrow(tidied(_added), "first long, block int, part binary").collect()}
    if not found:
        return Latent(0, np.zeros(SIZE), np.zeros((SIZE, SIZE)))
    *rows, last = (np.frombuffer(found[k], np.float64) for k in sorted(found))
    product = np.zeros((SIZE, SIZE))
    for at, own in zip(range(0, SIZE, BLOCK), rows):
        own = own.reshape(-1, SIZE - at)
        product[at : at + BLOCK, at:] = own
        product[at:, at : at + BLOCK] = own.T
    return Latent(int(last[-1]), last[:-1], product)


def _project(space, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            z = space.value.project(features(*buffer_of(batch.column("text")))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([row.tobytes() for row in z], pa.binary())], names=["label", "point"])


def _cell(centres, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = np.frombuffer(b"".join(batch.column("point").to_pylist()), np.float32).reshape(-1, centres.value.shape[1])
        own = [(points[at : at + 4096] @ centres.value.T).argmax(axis=1) for at in range(0, len(points), 4096)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int32)), batch.column("label"), batch.column("point")], names=["cell", "label", "point"])


def celled(points: DataFrame, width: int, seeds: int = SEEDS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """points by cell, those around the nearest of some centres; the centres; and some of the points, those of the least hash.

    Cells and seeds only spare comparisons: see vote. Up to seeds points aren't worth it, and stay as they are.
    """
    n = points.count()
    if n <= seeds:
        return points, *(np.zeros((0, width), np.float32),) * 2
    some = points.orderBy(F.xxhash64("point"), "point").limit(seeds).select("point").collect()
    some = np.frombuffer(b"".join(bytes(r.point) for r in some), np.float32).reshape(-1, width)
    distinct = np.unique(some[_unit(some)], axis=0)
    centres = distinct[np.random.default_rng(5).permutation(len(distinct))[: min(2048, int(n**0.5))]]
    if not len(centres):
        return points, centres, some
    own = points.select("label", "point").mapInArrow(tidied(partial(_cell, points.sparkSession.sparkContext.broadcast(centres))), "cell int, label int, point binary")
    return write_table(own.repartitionByRange("cell").sortWithinPartitions("cell"), "cells"), centres, some


def _unit(z: np.ndarray) -> np.ndarray:
    return np.abs(np.sqrt((z * z).sum(axis=1)) - 1) < 1e-5


def voters(files: list[str], width: int, rows: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, points and cells of the files' rows, block by block."""
    for uri in files:
        system, path = pa.fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(rows, columns=["label", "point", "cell"]):
                points = np.frombuffer(b"".join(batch.column("point").to_pylist()), np.float32).reshape(-1, width)
                yield batch.column("label").to_numpy(zero_copy_only=False).astype(np.float32), points, batch.column("cell").to_numpy(zero_copy_only=False)


#: What rounding may add to or take from a cosine.
_SLACK = np.float32(1e-5)


def _floor(z: np.ndarray, seeds: np.ndarray, k: int, rows: int) -> np.ndarray:
    """A cosine that the k nearest of each of z reach, since k seeds do."""
    out = np.full(len(z), -np.inf, np.float32)
    if len(seeds) >= k:
        for at in range(0, len(z), rows):
            out[at : at + rows] = np.partition(z[at : at + rows] @ seeds.T, -k, axis=1)[:, -k] - _SLACK
    return out


def _reach(near: np.ndarray, points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The most that the cosine with any of points can be for vectors whose cosine with centre is near: by the angles of a triangle."""
    a = np.minimum(near + _SLACK, np.float32(1))
    r = np.float32(max(float((points @ centre).min()) - float(_SLACK), -1.0))
    return np.where(a >= r, np.float32(1), a * r + np.sqrt(np.maximum(0, (1 - a * a) * (1 - r * r)))) + _SLACK


def vote(z: np.ndarray, blocks: Iterator[tuple[np.ndarray, ...]], k: int = VOTERS, rows: int = 512, centres: np.ndarray | None = None, seeds: np.ndarray | None = None) -> np.ndarray:
    """Share of label 1 among the k of all blocks nearest by cosine, weighted by similarity; 1 without labelled documents.

    Blocks are labels and points, with centres also cells in runs. A run that can't hold one of the k nearest
    is left out for the rows where that is certain, so the k nearest are the same as without centres.
    """
    best, said = np.full((len(z), k), -np.inf, np.float32), np.zeros((len(z), k), np.float32)
    by_cell = centres is not None and len(centres) > 0
    least = _floor(z, seeds, k, rows) if by_cell else np.full(len(z), -np.inf, np.float32)
    near, free = (np.ascontiguousarray(centres @ z.T), ~_unit(z)) if by_cell else (None, None)

    def met(here: np.ndarray | slice, y: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of here, cosines and labels of the points that may be among their nearest."""
        cos, limit = z[here] @ points.T, least[here]
        at = np.arange(len(z))[here]
        if len(y) > k and np.isinf(limit).any():
            nearest = np.argpartition(cos, -k, axis=1)[:, -k:]
            return np.repeat(at, k), np.take_along_axis(cos, nearest, axis=1).ravel(), y[nearest].ravel()
        row, col = np.divmod(np.flatnonzero(cos > limit[:, None]), len(y))
        return at[row], cos[row, col], y[col]

    def merge(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        row, value, label = (np.concatenate(x) for x in zip(*found))
        if len(row):
            some, row = np.unique(row, return_inverse=True)
            row = np.concatenate([np.repeat(np.arange(len(some)), k), row])
            value, label = np.concatenate([best[some].ravel(), value]), np.concatenate([said[some].ravel(), label])
            order = np.lexsort((-value, row))
            counts = np.bincount(row, minlength=len(some))
            first = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts) < k
            best[some], said[some] = value[order][first].reshape(-1, k), label[order][first].reshape(-1, k)
            least[some] = np.maximum(least[some], best[some].min(axis=1))

    for y, points, *cell in blocks:
        if not len(y):
            continue
        if not by_cell:
            for at in range(0, len(z), rows):
                merge([met(slice(at, at + rows), y, points)])
            continue
        found, size = [], 0
        cuts = [0, *(np.flatnonzero(np.diff(cell[0])) + 1).tolist(), len(y)]
        for lo, hi in zip(cuts, cuts[1:]):
            own, at = points[lo:hi], cell[0][lo]
            reach = _reach(near[at], own, centres[at]) if _unit(own).all() else np.float32(np.inf)
            rest = np.flatnonzero(free | (reach > least))
            for i in range(0, len(rest), rows):
                found.append(met(rest[i : i + rows], y[lo:hi], own))
                size += len(found[-1][0])
            # what waits is bounded
            if found and (size > 1 << 20 or hi == len(y)):
                merge(found)
                found, size = [], 0
    w = np.where(np.isinf(best), 0, np.maximum(best.astype(np.float64), 1e-6) ** 4)
    total = w.sum(axis=1)
    return np.clip(np.where(total > 0, (w * said).sum(axis=1) / np.where(total > 0, total, 1), 1), 0, 1)


def _score(space, files: list[str], found, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def voted(held: list[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        centres, seeds = found.value
        score = vote(np.concatenate([z for _, z in held]), voters(files, space.value.axes.shape[1]), centres=centres, seeds=seeds)
        at = 0
        for batch, z in held:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score[at : at + len(z)])], names=[*batch.schema.names, "score"])
            at += len(z)

    # the voters are read once for each 16 MB of documents
    held: list[tuple[pa.RecordBatch, np.ndarray]] = []
    size = 0
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            held.append((batch, space.value.project(features(*buffer_of(batch.column("text"))))))
            size += batch.nbytes
            if size >= 16 << 20:
                yield from voted(held)
                held, size = [], 0
    if held:
        yield from voted(held)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text and any columns but score) with score: how likely each whole text is of quality 1.

    Learns from all documents of either label (columns doc_id and quality of labels, repeated
    rows once, a document labelled both counts for both) whose crc32(doc_id) mod 3 isn't 1: the latent space is theirs, and
    all of them vote. Their latent vectors (256 bytes each) are a table in the shared folder, by cell, that tasks read in
    blocks; cells that can't hold one of the nearest are passed over, yet the time for votes grows with documents times labelled ones. Null and empty texts have zero counts and are voted on like others. Without labels every score
    is 1, so that nothing is rejected for want of evidence.
    """
    plain = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = write_table(labelled(plain, labels, "quality", remainder(3) != 1, {0: None, 1: None}).sortWithinPartitions("doc_id", "label"), "labelled")
    space = docs.sparkSession.sparkContext.broadcast(latent(known))
    points = write_table(known.mapInArrow(tidied(partial(_project, space)), "label int, point binary").withColumn("cell", F.lit(0)), "points")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    cells, *found = celled(points, space.value.axes.shape[1])
    files = sorted(cells.inputFiles())
    return docs.mapInArrow(tidied(partial(_score, space, files, docs.sparkSession.sparkContext.broadcast(tuple(found)))), schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod 3 is 1), score, predicted (1 if score >= 0.5) for every row of docs; see scored."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(own, labels).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their columns doc_id, text, lang, source and n_chars, whose score is at least 0.5."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source", "n_chars")
    return scored(own, labels).where("score >= 0.5").drop("score")
