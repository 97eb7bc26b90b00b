"""Benchmark decontamination: a generalised suffix automaton of normalised test items, streamed over training words."""

from __future__ import annotations

import pickle
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded, tidied, write_table
from .text import ALNUM, buffer_of, hash_words, mix, slices, words_of

#: Bytes of item texts in one automaton (built by one task, some 120 bytes of memory a byte), and in those that one pass over the documents holds (some 10).
BLOCK_BYTES, PASS_BYTES = 2 << 20, 16 << 20
#: Bytes of a row of a written automaton.
_CHUNK = 8 << 20
SPANS = "spans array<struct<start:long,end:long>>, items array<long>"
_HELD: dict[str, list[Automaton]] = {}


class Automaton:
    """A generalised suffix automaton of the words of items, as arrays: the states of all their substrings.

    A window is window consecutive words of an item; an item of fewer words, but not none, is one window. Words are
    told apart by 64-bit hashes. Items without an id count as one.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.window = window
        data, offsets = buffer_of(pa.array([t for _, t in items], pa.string()))
        starts, ends, first = words_of(data, offsets, ALNUM)
        hashes = hash_words(data, starts, ends)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        own = [(k, ids[first[k] : first[k + 1]].tolist()) for k in range(len(items)) if first[k + 1] > first[k]]
        self._next: list[dict[int, int]] = [{}]
        self._link, self._len = [-1], [0]
        for _, words in own:
            self._add(words)
        found: dict[int, set[int]] = {}
        short: dict[int, set[int]] = {}
        for k, words in own:
            state = 0
            for i, w in enumerate(words):
                state = self._next[state][w]
                if i + 1 >= window:
                    cut = state
                    while self._len[self._link[cut]] >= window:
                        cut = self._link[cut]
                    found.setdefault(cut, set()).add(k)
            if len(words) < window:
                short.setdefault(state, set()).add(k)
        # transitions as ascending keys, state * 2^32 + word, and their targets
        keys = np.array([(s << 32) | w for s, step in enumerate(self._next) for w in sorted(step)], dtype=np.uint64)
        self.keys, self.targets = keys, np.array([step[w] for step in self._next for w in sorted(step)], dtype=np.int32)
        self.link, self.len = np.array(self._link, dtype=np.int32), np.array(self._len, dtype=np.int32)
        # the state of the last window words of a match that ends in a state, and the longest short item that is a suffix of it
        self.cut, self.end = np.arange(len(self.len), dtype=np.int32), np.full(len(self.len), -1, dtype=np.int32)
        for s in np.argsort(self.len, kind="stable")[1:].tolist():
            if self.len[self.link[s]] >= window:
                self.cut[s] = self.cut[self.link[s]]
            self.end[s] = s if s in short else self.end[self.link[s]] if self.link[s] > 0 else -1
        self.found, self.short = ({s: np.array(sorted(k), dtype=np.int32) for s, k in x.items()} for x in (found, short))
        self.ids = [i for i, _ in items]
        self.least = min((min(len(words), window) for _, words in own), default=0)
        grams = [hashes[first[k] : first[k + 1]] if self.least == 1 else _pairs(hashes[first[k] : first[k + 1]]) for k, _ in own]
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.bits = min(26, max(16, int(64 * len(grams)).bit_length()))
        self.known = np.zeros(1 << self.bits, dtype=bool)
        self.known[grams >> np.uint64(64 - self.bits)] = True
        self.known = np.packbits(self.known)
        del self._next, self._link, self._len

    def _add(self, own: list[int]) -> None:
        last, nxt = 0, self._next
        for w in own:
            if w in nxt[last]:
                q = nxt[last][w]
                last = q if self._len[q] == self._len[last] + 1 else self._clone(last, w, q)
                continue
            new = self._state(self._len[last] + 1)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = new
                p = self._link[p]
            if p == -1:
                self._link[new] = 0
            else:
                q = nxt[p][w]
                self._link[new] = q if self._len[q] == self._len[p] + 1 else self._clone(p, w, q)
            last = new

    def _state(self, length: int) -> int:
        self._next.append({})
        self._link.append(0)
        self._len.append(length)
        return len(self._len) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self._len[p] + 1)
        self._next[c] = dict(self._next[q])
        self._link[c], self._link[q] = self._link[q], c
        while p != -1 and self._next[p].get(w) == q:
            self._next[p][w] = c
            p = self._link[p]
        return c

    def maybe(self, grams: np.ndarray) -> np.ndarray:
        """Whether each word (or pair of words, where no item has one word) may occur in an item."""
        at = grams >> np.uint64(64 - self.bits)
        return (self.known[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1

    def stream(self, hashes: np.ndarray, at: int, spans: list[list[int]], items: set[int | None]) -> None:
        """Follow the words from place at on; add merged spans of window occurrences and the ids of the items they are of."""
        words = np.searchsorted(self.vocabulary, hashes)
        words[words == len(self.vocabulary)] = 0
        known = self.vocabulary[words] == hashes
        state, length, keys, n = 0, 0, self.keys, len(self.keys)
        hit: set[int] = set()
        for i, (w, there) in enumerate(zip(words.tolist(), known.tolist()), at):
            if not there:
                state = length = 0
                continue
            while True:
                key = np.uint64((state << 32) | w)
                k = bisect_left(keys, key)
                if k < n and keys[k] == key:
                    state, length = int(self.targets[k]), length + 1
                    break
                if not state:
                    break
                state = int(self.link[state])
                length = int(self.len[state])
            span = 0
            if length >= self.window:
                # a state stands for matches of several lengths; those within its class share what follows
                span = length
                hit.update(self.found[int(self.cut[state])].tolist())
            u = int(self.end[state]) if self.short and length else -1
            while u > 0:
                if self.len[u] <= length:
                    hit.update(self.short[u].tolist())
                    span = max(span, int(self.len[u]))
                u = int(self.end[self.link[u]]) if self.link[u] > 0 else -1
            if span:
                lo = i + 1 - span
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append([lo, i + 1])
        items.update(self.ids[k] for k in hit)


def _pairs(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])


def _match(name: str, shared, every: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of batches without text, or with it where every row is asked for, and n_words, spans and items; else only rows with a match."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = [pickle.loads(a) for a in shared.value]
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = buffer_of(batch.column("text"))
            starts, ends, first = words_of(data, offsets, ALNUM)
            hashes = hash_words(data, starts, ends)
            found: dict[int, tuple[list[list[int]], set[int | None]]] = {}
            for auto in _HELD[name]:
                if auto.least and len(starts):
                    _walk(auto, hashes, first, found)
            n = batch.num_rows
            spans: list = [[] for _ in range(n)]
            items: list = [[] for _ in range(n)]
            for row, (s, i) in found.items():
                spans[row], items[row] = _merged(s), sorted(i, key=lambda x: (x is None, x or 0))
            out = pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.diff(first)),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.int64())),
                ],
                names=[*batch.schema.names, "n_words", "spans", "items"],
            )
            if every:
                yield out
            elif found:
                yield out.take(pa.array(sorted(found))).select(["row", "spans", "items"])


def _walk(auto: Automaton, hashes: np.ndarray, first: np.ndarray, found: dict[int, tuple[list[list[int]], set[int | None]]]) -> None:
    """Add what the automaton finds in the stretches that may hold a window; first: where each row's words begin."""
    grams = _pairs(hashes) if auto.least > 1 else hashes
    known = np.zeros(len(grams) + 2, dtype=np.int8)
    known[1:-1] = auto.maybe(grams)
    if auto.least > 1:  # pairs across texts
        b = first[1:-1]
        b = b[(b > 0) & (b <= len(grams))]
        known[b] = 0
    turn = np.diff(known)
    lo, hi = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    wide = hi - lo >= max(1, auto.least - 1)
    for p, q in zip(lo[wide].tolist(), (hi[wide] + (auto.least > 1)).tolist()):
        # a run of single words may go on in the next text
        row = int(np.searchsorted(first, p, side="right")) - 1
        while p < q:
            to = min(q, int(first[row + 1]))
            if to > p:
                own = found.get(row, ([], set()))
                spans: list[list[int]] = []
                auto.stream(hashes[p:to], p - int(first[row]), spans, own[1])
                if spans:
                    found[row] = (own[0] + spans, own[1])
            p, row = to, row + 1


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _build(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, item_id, text) in order of blocks: the automaton of each block, in chunks."""

    def close(block: int, items: list) -> Iterator[pa.RecordBatch]:
        raw = pickle.dumps(Automaton(items, window))
        for k, at in enumerate(range(0, len(raw), _CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([k]), pa.array([raw[at : at + _CHUNK]], pa.binary())], names=["block", "chunk", "content"])

    last, held = None, []
    for batch in batches:
        for block, item, text in zip(*(batch.column(c).to_pylist() for c in ("block", "item_id", "text"))):
            if block != last and held:
                yield from close(last, held)
                held = []
            last = block
            held.append((item, text))
    if held:
        yield from close(last, held)


def automata(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, int]:
    """Automata of the items, spread over blocks of about block_bytes by the hash of id and text, each built by one task and written; and how many."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    one = items.repartition(blocks, "block").sortWithinPartitions("block")
    return write_table(one.mapInArrow(tidied(partial(_build, window)), "block long, chunk long, content binary"), "automata"), blocks


def _pass(built: DataFrame, lo: int, hi: int):
    """A broadcast of the automata of blocks lo to hi - 1: at most PASS_BYTES of item texts, whatever the benchmark's size."""
    parts: dict[int, list[bytes]] = {}
    for r in built.where((F.col("block") >= lo) & (F.col("block") < hi)).orderBy("block", "chunk").toLocalIterator():
        parts.setdefault(r.block, []).append(bytes(r.content))
    return built.sparkSession.sparkContext.broadcast([b"".join(x) for x in parts.values()])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans and items of the first pass with those of the others (more_spans, more_items: a list for each pass)."""
    for batch in batches:
        spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        for k, (s, i) in enumerate(zip(batch.column("more_spans").to_pylist(), batch.column("more_items").to_pylist())):
            if s:
                spans[k] = [{"start": a, "end": b} for a, b in _merged([[x["start"], x["end"]] for own in (spans[k], *s) for x in own])]
                items[k] = sorted({x for own in (items[k], *i) for x in own}, key=lambda x: (x is None, x or 0))
        out = batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(spans, batch.schema.field("spans").type))
        out = out.set_column(out.schema.get_field_index("items"), "items", pa.array(items, pa.list_(pa.int64())))
        yield out.drop_columns(["more_spans", "more_items"])


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = (), pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, text, the columns of carry, n_words, spans (merged word ranges that lie in occurrences of windows), items (their ids, sorted).

    One row per row of docs (doc_id long, text string; others aren't read); null text has no words. Items with
    null or blank text have no window; items with equal texts all count; rows with equal item_id are one item,
    and those without an id are one item, listed last as null. An empty benchmark matches nothing.

    Tasks build the automata, and the driver holds those of one pass (pass_bytes of item texts). Items within
    one pass need no shuffle. For more, documents are numbered and written, each pass reads them, and what later
    passes find is joined by number.
    """
    out = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    built, blocks = automata(benchmark, window, block_bytes)
    step = max(1, pass_bytes // block_bytes)
    if blocks > step:
        out = write_table(out.withColumn("row", F.monotonically_increasing_id()), "rows")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + f", n_words long, {SPANS}"
    done = out.mapInArrow(tidied(partial(_match, uuid.uuid4().hex, _pass(built, 0, step), True)), schema)
    if blocks <= step:
        return done
    more = None
    for lo in range(step, blocks, step):
        one = out.select("row", "text").mapInArrow(tidied(partial(_match, uuid.uuid4().hex, _pass(built, lo, lo + step), False)), f"row long, {SPANS}")
        more = write_table(one, "found") if more is None else more.union(write_table(one, "found"))
    more = more.groupBy("row").agg(F.collect_list("spans").alias("more_spans"), F.collect_list("items").alias("more_items"))
    done = done.join(more, "row", "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema if f.name not in ("more_spans", "more_items"))
    return done.mapInArrow(tidied(_joined), schema).drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and coverage * n_hit >= n_words)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return matches(docs, benchmark, window, block_bytes).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string")))), 256).alias("items_sha256"),
        ((n_hit > 0) & (coverage * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _remove(mark: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            if not spans:
                out.append(text)
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            s, e, _ = words_of(raw, np.array([0, len(raw)]), ALNUM)
            keep, at = [], 0
            for x in spans:
                keep += [raw[at : s[x["start"]]].tobytes(), mark.encode()]
                at = int(e[x["end"] - 1])
            out.append(b"".join([*keep, raw[at:].tobytes()]).decode())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20, block_bytes: int = BLOCK_BYTES, mark: str = "⟦cut⟧") -> DataFrame:
    """docs without test items: documents over the coverage limit go, in others each matching span gives way to mark.

    mark is a word of its own, so that what stood on either side of a span can't become a window; it may itself be
    no word of an item (else choose another).

    Returns the columns of documents (doc_id, text, lang, source, n_chars); n_chars is counted anew where
    text was cut; documents without a match, null and empty texts among them, stay as they are.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    found = matches(docs, benchmark, window, block_bytes, ("lang", "source", "n_chars"))
    found = found.where((n_hit == 0) | (coverage * n_hit < F.col("n_words")))
    out = found.mapInArrow(tidied(partial(_remove, mark)), found.schema)
    cut = F.size("spans") > 0
    return out.select("doc_id", "text", "lang", "source", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
