"""Connected components of an undirected graph given as edges, by union-find over forests and, beyond a checked size, star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import tidied, write_table

EDGES = "a long, b long"
#: Forest edges that one task may hold (16 bytes each, about 100 bytes while it works).
ONE_TASK = 4_000_000
_BATCH = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur and the smallest id each can reach: union-find with all unions of a round at once."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(ids))
    while True:
        px, py = parent[x], parent[y]
        open_ = px != py
        if not open_.any():
            return ids, ids[parent]
        x, y, px, py = x[open_], y[open_], px[open_], py[open_]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ids, root = roots(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        keep = ids != root
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep])], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size >= _BATCH:
            out = flush()
            held, size = [(out.column(0).to_numpy(), out.column(1).to_numpy())], out.num_rows
            if size >= _BATCH:
                yield out
                held, size = [], 0
    if size:
        yield flush()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if held:
        ids, root = roots(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        keep = ids != root
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep])], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of large-star or small-star; a > b in every edge of the input."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.join(least, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) for every id in edges (a long, b long); component is the smallest id reachable.

    Repeated edges, both directions and loops (a = b) are allowed; an empty table gives an empty table.
    Each task first reduces its edges to a forest. A forest of at most one_task edges is finished by one
    task; a larger one by alternating large and small stars, each round written to the shared folder.
    """
    forest = write_table(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(tidied(_forest), EDGES), "forest")
    if forest.count() <= one_task:
        return _with_roots(forest.repartition(1).mapInArrow(tidied(_whole), EDGES))
    now, before = forest, None
    while True:
        now = write_table(_star(_star(now, True), False), "stars")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return _with_roots(now)
        before = state


def _with_roots(stars: DataFrame) -> DataFrame:
    stars = write_table(stars, "components")
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.select("b", "b").distinct().toDF("id", "component"))
