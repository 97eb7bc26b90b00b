"""Near-duplicate texts: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import bounded, tidied, write_table
from .text import NONSPACE, buffer_of, hash_words, mix, slices, words_of

#: Slots of a signature, a prime: a step and an offset below it then walk each slot once.
SLOTS = 193
BANDS, ROWS = 32, 6
_SEED1, _SEED2 = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and the n + 1 places where each text's set begins."""
    starts, ends, first = words_of(data, offsets, NONSPACE)
    h = hash_words(data, starts, ends)
    n = len(offsets) - 1
    counts = np.diff(first)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    if len(h) == 0:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(h), dtype=np.uint64)
        odd = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(width)]
        for k in range(width):
            rolled[: len(h) - k] += h[k:] * odd[k]
    out = np.empty(int(sizes.sum()), dtype=np.uint64)
    places = np.zeros(n + 1, dtype=np.int64)
    at = 0
    for i in range(n):
        c, p = int(counts[i]), int(first[i])
        if c >= width:
            own = mix(rolled[p : p + c - width + 1])
            own.sort()
            if len(own) > 1:
                fresh = np.empty(len(own), dtype=bool)
                fresh[0] = True
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                own = own[fresh]
            out[at : at + len(own)] = own
            at += len(own)
        elif c:
            value = 0x27D4EB2F165667C5 + c
            for x in h[p : p + c].tolist():
                value = (value * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
            out[at] = value
            at += 1
        places[i + 1] = at
    return out[:at], places


def signatures(sets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """SuperMinHash: (texts, SLOTS). Element e puts r_j(e) + j into the j-th slot of its own walk of all slots.

    Each slot keeps its least value. All elements of all texts take step j together; a text whose slots all
    hold values below j is finished, since step j and later ones only bring values of j and more.
    """
    n = len(places) - 1
    sig = np.full(n * SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(places))
    x = sets
    if len(x) == 0:
        return sig.reshape(n, SLOTS)
    walk = mix(x ^ _SEED1)
    place = (walk % np.uint64(SLOTS)).astype(np.int64)
    step = ((walk >> np.uint64(20)) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    state = mix(x ^ _SEED2)
    for j in range(SLOTS):
        rank = state >> np.uint64(24)
        rank += np.uint64(j << 40)
        np.minimum.at(sig, owner * SLOTS + place, rank)
        if j + 1 == SLOTS:
            break
        open_ = (sig.reshape(n, SLOTS).max(axis=1) >> np.uint64(40)) > j
        keep = open_[owner]
        if not keep.any():
            break
        if not keep.all():
            owner, place, step, state = owner[keep], place[keep], step[keep], state[keep]
        place = place + step
        place[place >= SLOTS] -= SLOTS
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
    return sig.reshape(n, SLOTS)


SKETCH = "row long, doc_id long, n_shingles long, set_a long, set_b long, bits array<long>, bands array<long>"


def _sketch(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets, places = shingle_sets(*buffer_of(batch.column("text")), width)
            n = batch.num_rows
            sig = signatures(sets, places)
            sizes = np.diff(places)
            with np.errstate(over="ignore"):
                sums = np.zeros((2, len(sets) + 1), dtype=np.uint64)
                np.cumsum(sets, out=sums[0, 1:])
                np.cumsum(mix(sets ^ np.uint64(0x1B873593CC9E2D51)), out=sums[1, 1:])
                a, b = (s[places[1:]] - s[places[:-1]] for s in sums)
                bands = np.zeros((n, BANDS), dtype=np.uint64)
                for k in range(ROWS):
                    bands = bands * np.uint64(0x9DDFEA08EB382D69) + sig[:, k : BANDS * ROWS : ROWS]
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
                one = (mix(sig[:, :192].copy()) & np.uint64(1)).reshape(n, 3, 64)
                bits = (one << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(a.view(np.int64)),
                    pa.array(b.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 3), pa.array(bits.reshape(-1).view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64))),
                ],
                names=["row", "doc_id", "n_shingles", "set_a", "set_b", "bits", "bands"],
            )


def _verify(width: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (head, salt, row, text) with each head's own text first in its group: true links to the head."""
    key, held = None, None
    for whole in batches:
        for batch in slices(whole, "text"):
            sets, places = shingle_sets(*buffer_of(batch.column("text")), width)
            a, b = [], []
            for i, k in enumerate(zip(batch.column("head").to_pylist(), batch.column("salt").to_pylist(), batch.column("row").to_pylist())):
                own = sets[places[i] : places[i + 1]]
                if k[0] == k[2]:
                    key, held = k[:2], own.copy()
                    continue
                if k[:2] != key:
                    raise ValueError(f"the text of row {k[0]} is missing")
                at = np.searchsorted(held, own)
                at[at == len(held)] = 0
                common = int((held[at] == own).sum()) if len(held) else 0
                if 100 * common >= percent * (len(held) + len(own) - common):
                    a.append(k[2])
                    b.append(k[0])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, per_salt: int, broadcast_rows: int) -> DataFrame:
    """True links among pairs (a, head): the texts of each head and its partners meet in one sorted run.

    A head with many partners is split over salts, each with its own copy of the head's text.
    """
    pairs = write_table(pairs, "pairs")
    many = pairs.groupBy("head").count().where(F.col("count") > per_salt).select("head", F.ceil(F.col("count") / per_salt).cast("int").alias("salts"))
    pairs = pairs.join(many, "head", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    pairs = pairs.select("head", F.expr("cast(pmod(xxhash64(a), salts) as int)").alias("salt"), F.col("a").alias("row"))
    heads = pairs.select("head", "salt").distinct().select("head", "salt", F.col("head").alias("row"))
    wanted = write_table(pairs.union(heads), "wanted")
    # at most broadcast_rows rows of two longs and an int
    small = wanted.count() <= broadcast_rows
    met = texts.join(F.broadcast(wanted) if small else wanted, "row").select("head", "salt", "row", "text")
    run = met.repartition("head", "salt").sortWithinPartitions("head", "salt", F.col("head") != F.col("row"))
    return run.mapInArrow(tidied(partial(_verify, width, percent)), "a long, b long")


def spread(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """left with the columns of right (one row a key, and copies, the rows of left that have the key), or nulls.

    Keys of more than hot_rows rows are joined by broadcast, since no more of them can exist than rows of left / hot_rows.
    """
    hot, cold = right.where(F.col("copies") > hot_rows).drop("copies"), right.where(F.col("copies") <= hot_rows).drop("copies")
    if hot.isEmpty():
        return left.join(cold, keys, "left")
    cool = left.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys, "left")
    return left.join(F.broadcast(hot), keys).unionByName(cool)


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text and columns of docs, each row with a number (row), written once so that numbers stay."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)
    return write_table(own.withColumn("row", F.monotonically_increasing_id()), "rows")


def grouped(rows: DataFrame, width: int = 3, percent: int = 85, per_salt: int = 5_000, broadcast_rows: int = 500_000, hot_rows: int = 100_000, cell: int = 2_000) -> DataFrame:
    """row, doc_id, n_shingles, component_id, chosen for every row of rows (as numbered() gives them).

    component_id is the smallest doc_id of the row's group, chosen one row of it: the first with that doc_id.
    """
    rows = bounded(rows)
    texts = rows.select("row", "text")
    sketch = write_table(rows.select("row", "doc_id", "text").mapInArrow(tidied(partial(_sketch, width)), SKETCH), "sketch")
    full = sketch.where("n_shingles > 0")
    same = full.groupBy("n_shingles", "set_a", "set_b").agg(F.min("row").alias("head"), F.count("*").alias("copies"), F.first(F.struct("bits", "bands")).alias("s"))
    same = write_table(same, "sets")

    # buckets are made of ids alone; sizes and bits join only the pairs and rows that are left
    marks = same.select(F.col("head").alias("id"), F.col("n_shingles").alias("n"), F.col("s.bits").alias("bits"))
    signed = same.select(F.col("head").alias("id"), F.explode("s.bands").alias("band"))
    least = signed.groupBy("band").agg(F.min("id").alias("h"), F.count("*").alias("size")).where("size > 1").drop("size")
    bucketed = write_table(signed.join(least, "band"), "buckets")

    def close(x: str, y: str, nx: str, ny: str) -> str:
        bits = " + ".join(f"bit_count({x}[{k}] ^ {y}[{k}])" for k in range(3))
        # one bit agrees with a chance of (1 + J) / 2
        return f"100 * least({nx}, {ny}) >= {percent} * greatest({nx}, {ny}) and {bits} <= {round(192 * ((1 - percent / 100) / 2 + 5 * ((1 - (percent / 100) ** 2) / 4 / 192) ** 0.5))}"

    first = bucketed.where("id <> h").select("id", "h").distinct().join(marks, "id").join(marks.toDF("h", "hn", "hbits"), "h")
    first = write_table(first.where(close("bits", "hbits", "n", "hn")).select(F.col("id").alias("a"), F.col("h").alias("head")), "first")
    stars = write_table(_confirmed(first, texts, width, percent, per_salt, broadcast_rows), "links")
    joined = connected_components(stars)

    left = bucketed.select("band", "id").join(joined, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    split = left.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    # a large bucket is cut into blocks, and each pair of blocks is a cell of its own
    left = left.join(split.select("band", F.ceil(F.col("size") / cell).cast("int").alias("blocks")), "band").join(marks, "id")
    left = write_table(left.withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)")), "open")
    cells = left.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    x, y = cells.where("block = i").alias("x"), cells.where("block = j").alias("y")
    rest = x.join(y, F.expr(f"x.band = y.band and x.i = y.i and x.j = y.j and (x.i < x.j or x.id < y.id) and x.c <> y.c and {close('x.bits', 'y.bits', 'x.n', 'y.n')}"))
    rest = rest.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("head")).distinct().join(first, ["a", "head"], "left_anti")
    more = _confirmed(rest, texts, width, percent, per_salt, broadcast_rows)

    # nodes: the first row of each set; for rows with repeated doc_ids, and those with an empty set, the first row of the doc_id, less than 0
    own = spread(full.select("row", "doc_id", "n_shingles", "set_a", "set_b"), same.where("copies > 1").select("n_shingles", "set_a", "set_b", "head", "copies"), ["n_shingles", "set_a", "set_b"], hot_rows)
    own = own.select("row", "doc_id", "n_shingles", F.coalesce("head", "row").alias("head")).union(sketch.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.lit(None).cast("long")))
    again = write_table(sketch.where("doc_id is not null").groupBy("doc_id").agg(F.min("row").alias("begin"), F.count("*").alias("copies")).where("copies > 1"), "repeated")
    own = spread(own, again, ["doc_id"], hot_rows)
    own = write_table(own.select("row", "doc_id", "n_shingles", F.coalesce("head", -F.coalesce("begin", "row") - 1).alias("node"), (-F.col("begin") - 1).alias("twin")), "nodes")
    twins = own.where("twin is not null and twin <> node").select(F.col("node").alias("a"), F.col("twin").alias("b")).distinct()
    whole = connected_components(stars.union(more).union(twins))

    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    nodes = own.groupBy("node").agg(best, F.count("*").alias("copies")).join(whole.withColumnRenamed("id", "node"), "node", "left")
    nodes = write_table(nodes.select("node", "best", "copies", F.coalesce("component", "node").alias("component")), "members")
    groups = nodes.groupBy("component").agg(F.min("best").alias("best"), F.count("*").alias("copies"))
    groups = write_table(groups.select("component", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("chosen"), "copies"), "groups")
    found = write_table(spread(nodes.select("node", "component", F.col("copies").alias("size")), groups, ["component"], hot_rows).select("node", "component_id", "chosen", F.col("size").alias("copies")), "found")
    return spread(own.select("row", "doc_id", "n_shingles", "node"), found, ["node"], hot_rows).select("row", "doc_id", "n_shingles", "component_id", "chosen")


def near_duplicates(docs: DataFrame, **how: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id long, text string, any others).

    Links: two texts whose sets of distinct width-word shingles have 100 * intersection >= percent * union.
    Words are runs of anything but ASCII white space with A-Z as a-z; a text of fewer words is one shingle;
    a null, empty or blank text has an empty set and links with nothing. Rows with equal doc_id count as one
    document that has the texts of all of them: each row is returned, with the component of the id. A row
    without a doc_id is a document of its own; its component_id is the smallest doc_id that it reaches, else null,
    and it is kept if its group has no doc_id and it is the first of it. Other columns, whatever their names,
    aren't read; an empty table gives an empty result.

    Rows are numbered and written first. Equal sets are folded, so copies cost one row each. Banding of 32 x 6
    SuperMinHash slots misses a pair at the limit with a chance of (1 - 0.85 ** 6) ** 32 < 3e-7. In each bucket
    all are first compared with its least document; then pairs that are still in different components, compatible
    in size and by their 192 one-bit slots (five standard deviations), are compared, in blocks of a large bucket:
    links that can change no component are spared. how: the parameters of grouped().
    """
    out = grouped(numbered(docs), **how)
    kept = F.when(F.col("doc_id").isNull(), F.col("row") == F.col("chosen")).otherwise(F.col("doc_id") == F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def representatives(docs: DataFrame, *columns: str, **how: int) -> DataFrame:
    """One row of each group of near-duplicates, with doc_id, text and columns: of the smallest doc_id, the first row; groups as near_duplicates() says.

    Of rows that repeat a doc_id, and of equal texts without one, one stays.
    """
    rows = numbered(docs, *columns)
    chosen = grouped(rows, **how).select(F.col("chosen").alias("row")).distinct()
    return rows.join(chosen, "row", "left_semi").select("doc_id", "text", *columns)
