"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared on every window."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded, tidied
from .text import NONSPACE, buffer_of, slices, words_of
from .training import fit, labelled, remainder

#: Words in a window: of those that are scored, and of those that toxic documents give to their dictionary.
WINDOW, SMALL = 5, 1
#: Bytes of the trained dictionary of ordinary text at most; segment and gram length of its trainer; rounds of selection.
BASE, SEGMENT, GRAM, ROUNDS = 400_000, 64, 8, 4
#: A small window of a toxic document is selected if differences like its own are so many times as frequent as in ordinary documents.
RATIO, FIRST, GROW = 8.0, 1.3, 2.0
#: Length differences from LEAST to MOST are told apart. Windows in a group: a dense passage counts by its best group.
LEAST, MOST, GROUP = -4, 16, 4
#: Windows in a section: a text is as toxic as its most toxic section, so that a long text hides no passage.
SECTION = 60
#: Stand before and behind a window, and behind both dictionaries, so that every window compresses and none is stored as it is.
#: The second is longer, as the compressor looks for no match in the last 16 bytes.
AHEAD = np.array([4, 5, 6, 7, 8, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24], dtype=np.uint8)
BEHIND = np.concatenate([AHEAD, AHEAD[::-1], AHEAD[::2]])
_HOW = zstd.ZstdCompressionParameters(window_log=21, hash_log=18, chain_log=19, search_log=3, min_match=4, target_length=32, strategy=zstd.STRATEGY_LAZY, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)


class Windows:
    """Windows of width consecutive words, step words apart, of all texts: a blank before each word and after the last, between AHEAD and BEHIND."""

    def __init__(self, texts: pa.Array, width: int, step: int):
        data, offsets = buffer_of(pc.utf8_lower(pc.fill_null(texts, "")))
        starts, ends, first = words_of(data, offsets, NONSPACE)
        count = np.diff(first)
        many = np.where(count > 0, np.maximum(0, -(-(count - width) // step)) + 1, 0)
        self.first = np.concatenate([[0], np.cumsum(many)])
        self.owner = np.repeat(np.arange(len(count)), many)
        a = first[:-1][self.owner] + step * (np.arange(len(self.owner)) - self.first[:-1][self.owner])
        b = np.minimum(a + width, first[1:][self.owner])
        # a blank and its word, one word after another
        size = ends - starts + 1
        at = np.concatenate([[0], np.cumsum(size)])
        line = np.full(int(at[-1]), 32, dtype=np.uint8)
        inner = np.ones(len(line), dtype=bool)
        inner[at[:-1]] = False
        line[inner] = data[NONSPACE[data]]
        lo, own = at[a], at[b] - at[a]
        whole = own + 1 + len(AHEAD) + len(BEHIND)
        to = np.concatenate([[0], np.cumsum(whole)])
        raw = np.full(int(to[-1]), 32, dtype=np.uint8)
        if len(own):
            raw[to[:-1, None] + np.arange(len(AHEAD))] = AHEAD
            raw[to[1:, None] - len(BEHIND) + np.arange(len(BEHIND))] = BEHIND
            before = np.concatenate([[0], np.cumsum(own)])
            run = np.arange(int(before[-1]))
            raw[np.repeat(to[:-1] + len(AHEAD) - before[:-1], own) + run] = line[np.repeat(lo - before[:-1], own) + run]
        self.raw, self.places = raw.tobytes(), np.stack([to[:-1], whole], axis=1).astype(np.uint64)

    def __len__(self) -> int:
        return len(self.owner)

    def text(self, i: int) -> bytes:
        """A window without what stands at its ends."""
        at, size = self.places[i].tolist()
        return self.raw[at + len(AHEAD) : at + size - len(BEHIND)]


class Dictionaries:
    """Raw-content dictionaries: ordinary text, and toxic text before the same ordinary text."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _compressors(self) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
        if not hasattr(self, "_both"):
            self._both = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                book = zstd.ZstdCompressionDict(content + BEHIND.tobytes(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
                book.precompute_compress(compression_params=_HOW)
                self._both.append(zstd.ZstdCompressor(dict_data=book, compression_params=_HOW))
        return self._both

    def differences(self, windows: Windows) -> np.ndarray:
        """Compressed length with the ordinary dictionary less that with the toxic one, of each window, from LEAST to MOST."""
        if not len(windows):
            return np.zeros(0, dtype=np.int64)
        lengths = []
        for c in self._compressors():
            out = c.multi_compress_to_buffer(zstd.BufferWithSegments(windows.raw, windows.places.tobytes()), threads=0)
            lengths.append(np.fromiter(map(len, out), dtype=np.int64, count=len(windows)))
        return np.clip(lengths[0] - lengths[1], LEAST, MOST)


def sections(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in all windows where sections of at most SECTION begin and end, and the text of each; a text without windows is one empty section."""
    count = np.maximum(1, -(-np.diff(first) // SECTION))
    owner = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return np.concatenate([first[owner] + number * SECTION, first[-1:]]), owner


class Model:
    """The two dictionaries, the weight of each length difference, and the calibration of what a text's windows give together."""

    def __init__(self, books: Dictionaries):
        self.books = books
        self.weights = np.zeros(MOST - LEAST + 1)
        self.mean, self.variance = 0.0, 1.0
        self.scale, self.coefficients = np.ones(3), np.array([0.0, 0, 0, -10])

    def features(self, first: np.ndarray, differences: np.ndarray) -> np.ndarray:
        """Per section: by how many deviations the sum of weights is above that of ordinary windows, the best group's sum, and the logarithm of the number of windows."""
        w = self.weights[differences - LEAST]
        sums = np.concatenate([[0.0], np.cumsum(w)])
        lo, hi = first[:-1], first[1:]
        total, n = sums[hi] - sums[lo], (hi - lo).astype(float)
        best = np.zeros(len(lo))
        if len(w):
            owner = np.repeat(np.arange(len(lo)), hi - lo)
            i = np.arange(len(w))
            np.maximum.at(best, owner, sums[np.minimum(i + GROUP, hi[owner])] - sums[i])
        above = (total - n * self.mean) / np.sqrt(n * self.variance + 4)
        return np.stack([above, best, np.log1p(n)], axis=1)

    def calibrate(self, first: np.ndarray, differences: np.ndarray, y: np.ndarray) -> None:
        """Weights by the two classes' shares of each difference, then logistic regression on the features."""
        label = np.repeat(y, np.diff(first))
        hot, cold = (np.bincount(differences[label == k] - LEAST, minlength=len(self.weights)) + 1.0 for k in (1, 0))
        self.weights = np.log(hot / hot.sum()) - np.log(cold / cold.sum())
        # a window that toxic text compresses better still can't speak less for toxicity
        self.weights[-LEAST:] = np.maximum.accumulate(self.weights[-LEAST:])
        cold /= cold.sum()
        self.mean = float(cold @ self.weights)
        self.variance = float(cold @ (self.weights - self.mean) ** 2)
        at, owner = sections(first)
        x = self.features(at, differences)
        # of each text the section that is most above ordinary ones
        order = np.lexsort((-x[:, 0], owner))
        x = x[order[np.searchsorted(owner[order], np.arange(len(y)))]]
        self.scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
        design = np.concatenate([x / self.scale, np.ones((len(x), 1))], axis=1)
        w = np.zeros(design.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(len(w)), design.T @ (p - y) + 1e-2 * w)
            w -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        self.coefficients = w

    def scores(self, texts: pa.Array) -> np.ndarray:
        windows = Windows(texts, WINDOW, WINDOW)
        at, owner = sections(windows.first)
        x = self.features(at, self.books.differences(windows)) / self.scale
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, x @ self.coefficients[:-1] + self.coefficients[-1])
        return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def _trained(texts: list[str]) -> bytes:
    """BASE bytes: the dictionary that zstandard trains on texts, before it the texts themselves where its trainer gives less."""
    samples = [b" " + b" ".join(t.lower().encode().split()) + b" " for t in texts if len(t) > 100]
    whole = b"".join(samples)
    if len(whole) <= BASE:
        return whole
    book = zstd.train_dictionary(BASE, samples, k=SEGMENT, d=GRAM).as_bytes()
    return whole[: BASE - len(book)] + book


def select(halves: list[tuple[list[str], list[str]]], rounds: int = ROUNDS) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary from two halves of (ordinary texts, toxic texts).

    A document labelled toxic is mostly ordinary text, so the toxic dictionary takes those of its windows that
    tell: each half's windows are compared by dictionaries of the other half, whose toxic one first holds all its
    toxic texts; windows stay whose difference is RATIO times as frequent as among ordinary windows, and make the
    next round's dictionary.
    """
    hot = [Windows(pa.array(t, pa.string()), SMALL, 1) for _, t in halves]
    cold = [Windows(pa.array(o[: len(t) + 100], pa.string()), SMALL, 1) for o, t in halves]
    base = [_trained(o) for o, _ in halves]
    toxic = [b"".join(w.text(i) for i in range(0, len(w), SMALL)) for w in hot]
    for _r in range(rounds):
        books = [Dictionaries(base[h], toxic[h]) for h in (0, 1)]
        d = [books[1 - h].differences(hot[h]) for h in (0, 1)]
        e = [books[1 - h].differences(cold[h]) for h in (0, 1)]
        shares = []
        for x in (np.concatenate(d), np.concatenate(e)):
            n = np.bincount(x - LEAST, minlength=MOST - LEAST + 1)
            shares.append((n[::-1].cumsum()[::-1] + 0.5) / max(1, len(x)))
        good = [k for k in range(1 - LEAST, MOST - LEAST + 1) if shares[0][k] >= min(RATIO, FIRST + GROW * _r) * shares[1][k]]
        limit = min(good, default=MOST - LEAST) + LEAST
        toxic = [b"".join(dict.fromkeys(hot[h].text(i) for i in np.flatnonzero(d[h] >= limit).tolist())) for h in (0, 1)]
    return _trained(halves[0][0] + halves[1][0]), toxic[0] + toxic[1]


def train(batches: Iterator[pa.RecordBatch]) -> Model:
    """Rows part, label, text: dictionaries from parts 0 and 1, weights and calibration from part 2."""
    held: dict[tuple[int, int], list[str]] = {(p, k): [] for p in range(3) for k in (0, 1)}
    for batch in batches:
        for part, label, text in zip(*(batch.column(c).to_pylist() for c in ("part", "label", "text"))):
            held[part, label].append(text or "")
    model = Model(Dictionaries(*select([(held[p, 0], held[p, 1]) for p in (0, 1)])))
    texts = held[2, 0] + held[2, 1]
    y = np.array([0.0] * len(held[2, 0]) + [1.0] * len(held[2, 1]))
    if len(set(y)) == 2:
        windows = Windows(pa.array(texts, pa.string()), WINDOW, WINDOW)
        model.calibrate(windows.first, model.books.differences(windows), y)
    elif len(y):
        model.coefficients[-1] = 10.0 if y[0] else -10.0
    return model


def _score(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.scores(batch.column("text")), pa.float64())], names=["doc_id", "score"])


def toxicity(docs: DataFrame, labels: DataFrame, toxic_docs: int = 1200, ordinary_docs: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id long, text string; others aren't read).

    Learns from at most toxic_docs and ordinary_docs documents with label 1 and 0 (columns doc_id and toxic of
    labels, repeated rows once; a document labelled both counts for both) whose crc32(doc_id) mod 5 isn't 0. Three
    fifths of them give the dictionaries: zstandard's own trainer that of ordinary text, windows that compress
    better by toxic text that of toxic text. The others give the weight of each difference in compressed window
    length, and the calibration of a section's sums, so that 0.5 is the decision limit; the most toxic section decides. Every window of the whole text counts, byte for
    byte in lower case, with white space as one blank. Null, empty and blank texts have no window and get the score of sums of 0.
    Without labels of both classes all scores are near 0 (or 1, where only label 1 occurs).
    """
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = labelled(docs, labels, "toxic", remainder(5) != 0, {1: toxic_docs, 0: ordinary_docs})
    part = F.expr("case pmod(xxhash64(doc_id, 9), 10) when 0 then 0 when 1 then 0 when 2 then 0 when 3 then 1 when 4 then 1 when 5 then 1 else 2 end")
    model = fit(sample.select("doc_id", part.alias("part"), "label", "text"), train, F.col("part"), F.col("doc_id"))
    scored = docs.mapInArrow(tidied(partial(_score, docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, score double")
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
