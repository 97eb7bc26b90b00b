"""Embedding near-duplicates by spherical-cap filters: random product codes, list-decoded, joined, verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, roots
from .minhash import spread
from .storage import bounded, tidied, write_table

#: A direction is one of so many codewords in each of BLOCKS parts of a rotated vector; a vector lies in the caps of all directions
#: that exceed the limit, or of its LIST nearest where fewer do. At most WORDS codewords, at least LEAST_WORDS.
BLOCKS, LEAST_WORDS, WORDS, LIST = 4, 16, 256, 24
#: Distinct vectors of a label for each direction, about: more vectors get more directions, so buckets don't grow with the table.
PER_DIRECTION = 2
#: Rows of a bucket that one cell compares.
CELL = 1500

CAPS = "label long, dim int, head long, copies long, vector binary, caps array<long>"
FOUND = "id long, links long, root long"


@lru_cache(8)
def _code(dim: int, words: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], float]:
    """A random rotation, the parts of a vector, the unit codewords of each part, and the limit that more than LIST directions exceed for a tenth of vectors."""
    rng = np.random.default_rng(dim)
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    parts = [p for p in np.array_split(np.arange(dim), BLOCKS) if len(p)]
    code = []
    for p in parts:
        w = rng.standard_normal((words, len(p)))
        code.append(w / np.linalg.norm(w, axis=1, keepdims=True))
    x = rng.standard_normal((256, dim))
    best = nearest(x / np.linalg.norm(x, axis=1, keepdims=True) @ turn, parts, code, LIST)
    return turn, parts, code, float(np.quantile(best[:, -1], 0.9))


def nearest(y: np.ndarray, parts: list[np.ndarray], code: list[np.ndarray], most: int) -> np.ndarray:
    """The most greatest inner products of each rotated vector with directions, from the greatest on.

    A product with a direction is the sum of those of its parts, so the best sums over the first parts are all
    that can lead to the best sums over one part more.
    """
    total = np.zeros((len(y), 1))
    for p, w in zip(parts, code):
        total = (total[:, :, None] + (y[:, p] @ w.T)[:, None, :]).reshape(len(y), -1)
        if total.shape[1] > most:
            total = np.partition(total, total.shape[1] - most, axis=1)[:, -most:]
    return -np.sort(-total, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of finite numbers, none all zero, scaled to length 1 in double precision."""
    x = x.astype(np.float64)
    # the greatest becomes 1 to 2 by an exact power of two, whatever the range
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1] + 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def caps_of(x: np.ndarray, words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all directions that exceed the limit, ascending for each unit vector, and the n + 1 places where each vector's begin.

    The limit of a vector with fewer than LIST such directions is its LIST-th best product. Lists are decoded part
    by part: what a sum over the first parts lacks to the limit must be within reach of the other parts' best.
    """
    turn, parts, code, limit = _code(x.shape[1], words)
    y = x @ turn
    products = [y[:, p] @ w.T for p, w in zip(parts, code)]
    best = nearest(y, parts, code, LIST)
    need = np.minimum(limit, best[:, -1]) - 1e-12
    rest = np.cumsum([s.max(axis=1) for s in products[::-1]], axis=0)[::-1]
    row, ids, total = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for k, s in enumerate(products):
        ahead = rest[k + 1] if k + 1 < len(products) else np.zeros(len(x))
        sums = total[:, None] + s[row]
        i, w = np.nonzero(sums + ahead[row][:, None] >= need[row][:, None])
        row, ids, total = row[i], ids[i] * words + w, sums[i, w]
    order = np.lexsort((ids, row))
    return ids[order], np.searchsorted(row[order], np.arange(len(x) + 1))


def words_for(vectors: int) -> int:
    """Codewords of a part, for so many distinct vectors of the largest label: directions grow with them, in steps of the root of 2."""
    words = LEAST_WORDS
    while words < WORDS and words**BLOCKS * PER_DIRECTION < vectors:
        words = min(WORDS, int(words * 2**0.5))
    return words


def _decode(words: int, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("dim").to_numpy()
        vectors = batch.column("embedding")
        for dim in np.unique(sizes).tolist():
            own = batch.take(pa.array(np.flatnonzero(sizes == dim)))
            vectors = own.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for at in range(0, len(vectors), 2000):
                part = own.slice(at, 2000)
                x = np.ascontiguousarray(vectors[at : at + 2000], dtype=np.float64)
                caps, places = caps_of(unit(x), words)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("label", "dim", "head", "copies")),
                        pa.array([r.tobytes() for r in np.ascontiguousarray(vectors[at : at + 2000], dtype=kind)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(caps)),
                    ],
                    names=[c.split()[0] for c in CAPS.split(", ")],
                )


def _cell(cap: int, same: bool, side: np.ndarray, head: np.ndarray, copies: np.ndarray, x: np.ndarray, caps: pa.Array, least: float) -> pa.RecordBatch | None:
    """Links within a cell whose first shared cap is this one, as links and least partner of each vector."""
    if same:
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
    else:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = np.nonzero(x[left] @ x[right].T >= least)
        a, b = left[a], right[b]
    if not len(a):
        return None
    # which of the earlier caps of all its vectors each one lies in
    flat, size = caps.flatten().to_numpy(), np.diff(caps.offsets.to_numpy())
    owner, early = np.repeat(np.arange(len(size)), size), flat < cap
    names, column = np.unique(flat[early], return_inverse=True)
    keep = np.ones(len(a), dtype=bool)
    for lo in range(0, len(names), 4096):  # so many caps at once
        own = (column >= lo) & (column < lo + 4096)
        within = np.zeros((len(x), min(4096, len(names) - lo)), dtype=bool)
        within[owner[early][own], column[own] - lo] = True
        packed = np.packbits(within, axis=1)
        for at in range(0, len(a), 65536):
            keep[at : at + 65536] &= ~(packed[a[at : at + 65536]] & packed[b[at : at + 65536]]).any(axis=1)
    a, b = a[keep], b[keep]
    if not len(a):
        return None
    links = np.bincount(np.concatenate([a, b]), weights=np.concatenate([copies[b], copies[a]]), minlength=len(head)).astype(np.int64)
    ids, root = roots(head[a], head[b])
    order = np.argsort(head)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links[order[np.searchsorted(head[order], ids)]]), pa.array(root)], names=["id", "links", "root"])


def _earlier(flat: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Whether the rows a and b share a cap before cap; the ascending caps of row r stand from offsets[r] to offsets[r + 1] of flat."""
    out = np.zeros(len(a), dtype=bool)
    size = np.diff(offsets)
    plain = (size[a] == LIST) & (size[b] == LIST)
    at = np.flatnonzero(plain)
    for k in range(0, len(at), 4096):
        own = at[k : k + 4096]
        p, q = flat[offsets[a[own], None] + np.arange(LIST)], flat[offsets[b[own], None] + np.arange(LIST)]
        out[own] = ((p[:, :, None] == q[:, None, :]) & (p < cap[own, None])[:, :, None]).any(axis=(1, 2))
    # rows and caps as one ascending key
    keys = (np.repeat(np.arange(len(size)), size) << 33) | flat
    at = np.flatnonzero(~plain)
    for k in range(0, len(at), 65536):
        own = at[k : k + 65536]
        n = size[a[own]]
        pair = np.repeat(np.arange(len(own)), n)
        e = flat[np.repeat(offsets[a[own]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
        early = e < cap[own][pair]
        pair, want = pair[early], (b[own][pair[early]] << 33) | e[early]
        found = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        out[own[pair[keys[found] == want]]] = True
    return out


def _small_cells(starts: np.ndarray, sizes: np.ndarray, cap: np.ndarray, head: np.ndarray, copies: np.ndarray, x: np.ndarray, flat: np.ndarray, offsets: np.ndarray, least: float) -> pa.RecordBatch | None:
    """As _cell, for many cells at once, each a run of rows that are all compared with one another."""
    left, right = [], []
    for s in np.unique(sizes).tolist():
        i, j = np.triu_indices(s, 1)
        at = starts[sizes == s][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    a, b = np.concatenate(left), np.concatenate(right)
    near = np.zeros(len(a), dtype=bool)
    for k in range(0, len(a), 65536):
        near[k : k + 65536] = np.einsum("ij,ij->i", x[a[k : k + 65536]], x[b[k : k + 65536]]) >= least
    a, b = a[near], b[near]
    keep = ~_earlier(flat, offsets, a, b, cap[a])
    a, b = head[a[keep]], head[b[keep]]
    if not len(a):
        return None
    names, number = np.unique(head, return_inverse=True)
    weight = np.zeros(len(names), dtype=np.int64)
    weight[number] = copies
    p, q = np.searchsorted(names, a), np.searchsorted(names, b)
    links = np.bincount(np.concatenate([p, q]), weights=np.concatenate([weight[q], weight[p]]), minlength=len(names)).astype(np.int64)
    ids, root = roots(a, b)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links[np.searchsorted(names, ids)]), pa.array(root)], names=["id", "links", "root"])


#: Rows of a cell that is compared together with others.
SMALL = 64


def _verify(least: float, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (label, dim, cap, i, j): each run of equal keys is one cell."""
    columns = ("label", "dim", "cap", "i", "j")

    def closed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        keys = np.stack([t[c].to_numpy().astype(np.int64) for c in columns], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        starts, sizes = cuts[:-1], np.diff(cuts)
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        small = (sizes <= SMALL) & (keys[starts, 3] == keys[starts, 4])
        for dim in np.unique(keys[starts[small], 1]).tolist():
            own = small & (keys[starts, 1] == dim)
            rows = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[own].tolist(), sizes[own].tolist())])
            part = t.take(pa.array(rows)).combine_chunks()
            caps = part["caps"].combine_chunks()
            x = unit(np.frombuffer(b"".join(part["vector"].to_pylist()), kind).reshape(-1, dim))
            begin = np.concatenate([[0], np.cumsum(sizes[own])[:-1]])
            if out := _small_cells(begin, sizes[own], part["cap"].to_numpy(), part["head"].to_numpy(), part["copies"].to_numpy(), x, caps.flatten().to_numpy(), caps.offsets.to_numpy().astype(np.int64) - caps.offsets[0].as_py(), least):
                yield out
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
            part = t.slice(s, n).combine_chunks()
            x = unit(np.frombuffer(b"".join(part["vector"].to_pylist()), kind).reshape(n, -1))
            i, j = part["i"][0].as_py(), part["j"][0].as_py()
            caps = pa.array(part["caps"].to_pylist(), pa.list_(pa.int64()))
            if out := _cell(part["cap"][0].as_py(), i == j, (part["block"].to_numpy() != i).astype(int), part["head"].to_numpy(), part["copies"].to_numpy(), x, caps, least):
                yield out

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)
        # the last cell may go on in the next batch
        last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
        if last or (held and (np.array([held[-1].column(c)[-1].as_py() for c in columns]) != keys[0]).any()):
            done = [*held, batch.slice(0, last)] if last else held
            yield from closed(pa.Table.from_batches(done))
            held = []
        held.append(batch.slice(last))
    if held:
        yield from closed(pa.Table.from_batches(held))


def near_duplicates(vectors: DataFrame, least: float = 0.98, cell: int = CELL, broadcast_rows: int = 200_000, hot_rows: int = 100_000) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id long, embedding array of numbers, label a whole number).

    Vectors of equal label and length link when their cosine in double precision is at least least. Rows with
    a null label or an embedding that is null, empty, all zero or holds null or non-finite numbers link with
    nothing. Each row counts as a vector: a repeated row links with its twin. Rows with equal vec_id are linked by
    nothing else, and have the results of their own vectors; a null vec_id stays null. Other columns aren't read; an empty table
    gives an empty result.

    Equal vectors are folded first. A vector lies in the caps of all directions whose inner product exceeds a limit,
    or of its 24 nearest where fewer do; the number of directions follows that of the vectors (words_for). Two vectors
    at cosine 0.98 share a cap with a chance above 0.99 (measured in the tests). A bucket of more than cell vectors is split into blocks,
    and every pair of blocks is compared by itself; the list of such buckets is broadcast if it has at most
    broadcast_rows rows, else joined. A link counts only in the first cap that both ends share.
    """
    exact = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    number, kind = ("float", "<f4") if exact else ("double", "<f8")
    x = bounded(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{number}>").alias("embedding"), F.col("label").cast("long").alias("label"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = x.withColumn("usable", usable)
    able = rows.where("usable").withColumn("h", F.xxhash64("embedding")).withColumn("g", F.xxhash64(F.reverse("embedding"), F.lit(7)))
    groups = able.groupBy("label", "h", "g").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    # a number for each distinct vector; rows without an id have one too
    groups = write_table(groups.withColumn("head", F.monotonically_increasing_id()), "vectors")
    largest = groups.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    caps = groups.select("label", F.size("embedding").alias("dim"), "head", "copies", "embedding").mapInArrow(tidied(partial(_decode, words_for(largest), kind)), CAPS)
    caps = write_table(caps, "caps")

    big = caps.select("label", "dim", F.explode("caps").alias("cap")).groupBy("label", "dim", "cap").count().where(F.col("count") > cell)
    big = write_table(big.select("label", "dim", "cap", F.ceil(F.col("count") / cell).cast("int").alias("blocks")), "buckets")
    big = F.broadcast(big) if big.count() <= broadcast_rows else big
    own = caps.withColumn("cap", F.explode("caps")).join(big, ["label", "dim", "cap"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("block", F.expr("cast(pmod(xxhash64(head), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    own = own.select("label", "dim", "cap", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "head", "copies", "vector", "caps")
    cells = own.repartition("label", "dim", "cap", "i", "j").sortWithinPartitions("label", "dim", "cap", "i", "j")
    found = write_table(cells.mapInArrow(tidied(partial(_verify, least, kind)), FOUND), "found")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    folded = groups.drop("embedding").join(links, F.col("head") == F.col("id"), "left").drop("id").join(joined, F.col("head") == F.col("id"), "left").drop("id")
    folded = write_table(folded.withColumn("component", F.coalesce("component", "head")), "folded")
    ids = write_table(folded.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("copies")), "ids")
    folded = spread(folded.withColumnRenamed("copies", "same"), ids, ["component"], hot_rows).select("label", "h", "g", "links", "component_id", F.col("same").alias("copies"), (F.col("same") - 1).alias("twins"))
    out = spread(able.select("vec_id", "label", "h", "g"), write_table(folded, "results"), ["label", "h", "g"], hot_rows)
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("twins", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.union(rows.where("not usable").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)))
