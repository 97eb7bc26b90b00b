"""Labelled documents, models fitted on them by one task, and exact places in an order."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import tidied


def remainder(divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column, per_class: dict[int, int | None], broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, text, label of at most per_class documents a class (None: of all), those of the least hash; labels that aren't 0 or 1 don't count.

    A document labelled both is learnt as both; of rows that repeat a doc_id the least text counts, so the bound holds.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(learn & F.col("doc_id").isNotNull())
    chosen = None
    for label, most in per_class.items():
        own = known.where(F.col("label") == label).distinct()
        if most is not None:
            own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = own if chosen is None else chosen.union(own)
    # beyond broadcast_rows labels the texts are shuffled
    small = None not in per_class.values() or chosen.count() <= broadcast_rows
    met = docs.select("doc_id", "text").join(F.broadcast(chosen) if small else chosen.hint("merge"), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit(sample: DataFrame, train: Callable[[Iterator[pa.RecordBatch]], Any], *order: Column) -> Any:
    """What train makes of the batches of sample, in one task; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(batches))], pa.binary())], names=["model"])

    one = sample.repartition(1).sortWithinPartitions(*order) if order else sample.repartition(1)
    found = one.mapInArrow(tidied(run), "model binary").first()
    # a plan known to be empty runs no task
    return train(iter(())) if found is None else pickle.loads(found[0])


def least_but(bits: DataFrame, more: np.ndarray, k: int) -> int:
    """The value with k others before it in the order of column bits and of more (ints from 0 to 2 ** 31 - 1), exactly: counts by the upper half, then by the lower one."""

    def chosen(counts: DataFrame, own: np.ndarray, k: int) -> tuple[int, int]:
        total = np.bincount(own, minlength=1 << 16)
        for value, n in counts.collect():
            total[value] += n
        sums = np.cumsum(total)
        at = int(np.searchsorted(sums, k, side="right"))
        return at, k - int(sums[at] - total[at])

    upper = F.shiftright("bits", 16)
    high, k = chosen(bits.groupBy(upper).count(), more >> 16, k)
    low, _ = chosen(bits.where(upper == high).groupBy(F.col("bits").bitwiseAND(0xFFFF)).count(), more[more >> 16 == high] & 0xFFFF, k)
    return high << 16 | low


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of y on x by Newton steps with a little shrinkage."""
    a, b = 0.0, 0.0
    scale = max(1e-9, float(np.abs(x).max())) if len(x) else 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (p - y) + 1e-3 * w
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    a, b = w[0] / scale, w[1]
    return float(a), float(b)
