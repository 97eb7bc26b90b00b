"""Secret scans: base patterns, and a character convolutional network over every candidate and its context."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded, tidied, write_table
from .text import LOWER, buffer_of, code_points, slices
from .training import fit, least_but, remainder

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Bytes a candidate consists of, its least length, bytes of context on either side, bytes that one view reads at most at either end of what it is of.
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_CANDIDATE = _ALNUM.copy()
_CANDIDATE[[*b"+/_=-."]] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
LEAST, CONTEXT, BODY = 12, 24, 40
WIDTH = 2 * CONTEXT + 2 * BODY
#: Symbols the network tells apart: bytes by class with letters and digits kept, and whether they lie in the candidate.
SYMBOLS = 2 * 72


def _symbols() -> np.ndarray:
    out = np.full(256, 1)
    for i, c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789", 2):
        out[c] = i
    for i, c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        out[c] = 38 + i % 20
    for i, c in enumerate(b" \n=:\"'/+_-.,", 58):
        out[c] = i
    out[0x80:] = 70
    return out


_SYMBOL = _symbols()


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least least bytes of table, none across texts."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = table[data]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]) if len(cut) else cut
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    long = ends - starts >= least
    return starts[long], ends[long]


def base_spans(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) in bytes of all base findings of one text, by start, then kind."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    data = np.frombuffer(raw, np.uint8)
    s, e = runs(data, np.array([0, len(data)]), _HEX, 24)
    return sorted(out + [(a, 2, b, a) for a, b in zip(s.tolist(), e.tolist())])


def windows(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of each stretch (both ends of one beyond twice BODY bytes) between its contexts, 0 beyond the text: (stretches, WIDTH)."""
    at = np.arange(WIDTH)
    half = CONTEXT + BODY
    left = starts[:, None] + (at[:half] - CONTEXT)
    right = ends[:, None] + (at[half:] - half - BODY)
    lo, hi = offsets[owner][:, None], offsets[owner + 1][:, None]
    middle = ((starts + ends + 1) // 2)[:, None]
    ok = np.concatenate([(left >= lo) & (left < np.minimum(middle, hi)), (right >= np.maximum(middle, lo)) & (right < hi)], axis=1)
    place = np.concatenate([left, right], axis=1)
    inside = (place >= starts[:, None]) & (place < ends[:, None])
    symbol = _SYMBOL[data[np.clip(place, 0, max(0, len(data) - 1))]]
    return np.where(ok, symbol + 72 * inside, 0).astype(np.int16)


def views(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate, start and end of each view: all of a candidate up to twice BODY bytes; windows of that size, BODY apart, over the whole of a longer one."""
    count = 1 + np.maximum(0, -(-(ends - starts - 2 * BODY) // BODY))
    of = np.repeat(np.arange(len(starts)), count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = np.maximum(starts[of], np.minimum(starts[of] + step * BODY, ends[of] - 2 * BODY))
    return of, at, np.minimum(at + 2 * BODY, ends[of])


class Network:
    """Embedding, two widths of convolution with maximum and mean over places, one dense layer; float32 numpy."""

    EMBED, FILTERS, SPANS = 10, 24, (3, 5)

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.limit = 0.5
        self.p = {"e": rng.normal(0, 0.3, (SYMBOLS, self.EMBED))}
        for k in self.SPANS:
            self.p[f"w{k}"] = rng.normal(0, (1 / (k * self.EMBED)) ** 0.5, (k * self.EMBED, self.FILTERS))
            self.p[f"b{k}"] = np.zeros(self.FILTERS)
        self.p["v"] = rng.normal(0, 0.1, 2 * len(self.SPANS) * self.FILTERS)
        self.p["c"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        e = self.p["e"][x]
        hidden, kept = [], []
        for k in self.SPANS:
            n = WIDTH - k + 1
            wide = np.lib.stride_tricks.sliding_window_view(e, k, axis=1).transpose(0, 1, 3, 2).reshape(len(x) * n, k * self.EMBED)
            z = np.maximum(wide @ self.p[f"w{k}"] + self.p[f"b{k}"], 0).reshape(len(x), n, self.FILTERS)
            top = z.argmax(axis=1)
            hidden += [np.take_along_axis(z, top[:, None, :], axis=1)[:, 0], z.mean(axis=1)]
            kept.append((wide, z, top))
        h = np.concatenate(hidden, axis=1)
        return 1 / (1 + np.exp(-np.clip(h @ self.p["v"] + self.p["c"], -30, 30))), [h, kept]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (h, kept) = self.forward(x)
        d = ((p - y) / len(x)).astype(np.float32)
        g = {"v": h.T @ d, "c": d.sum(keepdims=True)}
        dh = d[:, None] * self.p["v"][None]
        de = np.zeros((*x.shape, self.EMBED), np.float32)
        for i, (k, (wide, z, top)) in enumerate(zip(self.SPANS, kept)):
            n = z.shape[1]
            dm, da = dh[:, 2 * i * self.FILTERS : (2 * i + 1) * self.FILTERS], dh[:, (2 * i + 1) * self.FILTERS : (2 * i + 2) * self.FILTERS]
            dz = np.repeat(da[:, None, :] / n, n, axis=1)
            np.put_along_axis(dz, top[:, None, :], np.take_along_axis(dz, top[:, None, :], axis=1) + dm[:, None, :], axis=1)
            dz = (dz * (z > 0)).reshape(-1, self.FILTERS)
            g[f"w{k}"], g[f"b{k}"] = wide.T @ dz, dz.sum(axis=0)
            dw = (dz @ self.p[f"w{k}"].T).reshape(len(x), n, k, self.EMBED)
            for j in range(k):
                de[:, j : j + n] += dw[:, :, j]
        g["e"] = np.stack([np.bincount(x.ravel(), weights=de[..., j].ravel(), minlength=SYMBOLS) for j in range(self.EMBED)], axis=1)
        return g

    def learn(self, x: np.ndarray, y: np.ndarray, rounds: int = 5, batch: int = 64, rate: float = 0.01) -> None:
        rng = np.random.default_rng(1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                t += 1
                for k, g in self.gradients(x[own], y[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def calibrate(self, most: float, least: float) -> None:
        """The highest limit at which scan() still finds the share of the secrets that reaches most, kept above what the others reach (least) where both can be had."""
        self.limit = float((most + least) / 2 if least < most else most)


def place(n: int, label: int, recall: float) -> int:
    """Where calibrate()'s bound lies among n scores in order: of secrets the one that the share recall reaches, of others that of 99.9 %."""
    return int((1 - recall) * n) if label else min(n - 1, int(0.999 * n))


def findings(seed: int, n: int) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, label): generated secrets of common forms and look-alikes that are none, in invented prose."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, int(rng.integers(2, 11)))
    any_ = low + up + dig
    secret = [
        lambda: "ghp_" + pick(any_, 36),
        lambda: "xoxb-" + pick(dig, 11) + "-" + pick(any_, 24),
        lambda: "sk_live_" + pick(any_, 24),
        lambda: "AIza" + pick(any_ + "_-", 35),
        lambda: "eyJ" + pick(any_, 20) + ".eyJ" + pick(any_, 30) + "." + pick(any_ + "_-", 43),
        lambda: pick(any_ + "+/", int(rng.integers(32, 64))) + "==",
        lambda: pick(any_, int(rng.integers(24, 48))),
        lambda: "glpat-" + pick(any_, 20),
        lambda: pick("0123456789ABCDEF", int(rng.choice([32, 40, 64]))),
    ]
    plain = [
        lambda: word() + "-" + word() + "-" + pick(dig, int(rng.integers(1, 5))) + "." + word(),
        lambda: pick(dig, int(rng.integers(12, 20))),
        lambda: "www." + word() + word() + ".example.com/" + word() + "/" + pick(dig, 4),
        lambda: pick(dig, 4) + "-" + pick(dig, 2) + "-" + pick(dig, 2) + "T" + pick(dig, 2) + pick(dig, 4),
        lambda: word() + word() + "_" + word() + pick(dig, 2),
        lambda: word() + pick(dig, 3) + "/" + word() + "/" + word() + ".html",
        lambda: word().upper() + "-" + pick(dig, 6) + "-" + word().upper(),
        lambda: pick(dig, 3) + "." + pick(dig, 3) + "." + pick(dig, 3) + "." + pick(dig, 3),
        lambda: (word() + word()).capitalize() + "." + word().capitalize() + "." + pick(dig, 1),
        lambda: word() + "=" + word() + "." + word() + pick(dig, 2) + "...",
        lambda: word() + "." + pick(dig, 2) + word() + "." + word() + "." + word(),
    ]
    ahead = ["key = \"", "auth: ", "credential=", "Bearer ", "", "", "", "with ", "see ", "id ", "file ", "on "]
    out = []
    for i in range(n):
        label = int(i % 2)
        made = (secret if label else plain)[int(rng.integers(len(secret if label else plain)))]()
        head = " ".join(word() for _ in range(5)) + " " + ahead[int(rng.integers(4 if label and rng.random() < 0.5 else 0, len(ahead)))]
        out.append((head + made + ("\"" if head.endswith("\"") else "") + " " + " ".join(word() for _ in range(5)), len(head), len(head) + len(made), label))
    return out


def wordy(seed: int, n: int) -> list[tuple[str, int, int, int]]:
    """As findings(), none a secret: names, compounds, paths and rules without a digit."""
    rng = np.random.default_rng(seed)
    part = lambda s: s[int(rng.integers(len(s)))]
    word = lambda: "".join(part(["", *"bcdfghlmnprstvw", "st", "tr", "pr"]) + part([*"aeiou", "ea", "io"]) + part(["", "", *"nrstl", "ng", "ch"]) for _ in range(int(rng.integers(1, 4))))
    words = lambda k: [word() for _ in range(int(rng.integers(k, 7)))]
    made = [
        lambda: "".join(words(4)),
        lambda: "".join(words(4)).upper(),
        lambda: "".join(w.capitalize() for w in words(3)),
        lambda: word() + "".join(w.capitalize() for w in words(3)),
        lambda: "_".join(words(3)),
        lambda: "_".join(words(3)).upper(),
        lambda: "-".join(words(3)),
        lambda: ".".join(words(3)),
        lambda: "/" + "/".join(words(3)) + part([".html", ".py", "/"]),
        lambda: "".join(words(4)).capitalize() + part([".", "...", ""]),
        lambda: part("=-_.+") * int(rng.integers(12, 70)),
    ]
    out = []
    for _ in range(n):
        head, own = " ".join(words(2)) + part([" ", " ", ' key = "', " see "]), part(made)()
        out.append((head + own + " " + " ".join(words(2)), len(head), len(head) + len(own), 0))
    return out


def long_findings(seed: int, n: int) -> list[tuple[str, int, int, int]]:
    """As findings(), in runs without a blank: a secret between look-alikes (start and end are its own), or look-alikes alone (those of the run)."""
    rng = np.random.default_rng(seed)
    made = findings(seed + 1000, 40 * n)
    secret, plain = ([t[s:e] for t, s, e, label in made if label == k] for k in (1, 0))

    def filler() -> str:
        out, size = "", int(rng.integers(50, 250))
        while len(out) < size:
            out += plain[int(rng.integers(len(plain)))] + "/=._-+"[int(rng.integers(6))]
        return out

    out = []
    for i in range(n):
        before, after = filler(), filler()
        own = (secret if i % 2 else plain)[i]
        whole = before + own + "/=.+"[int(rng.integers(4))] + after
        start, end = (5 + len(before), 5 + len(before) + len(own)) if i % 2 else (5, 5 + len(whole))
        out.append((f"seen {whole} here", start, end, i % 2))
    return out


def joined(found: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of findings, and where each begins."""
    raw = [f[0].encode() if isinstance(f[0], str) else f[0] for f in found]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def _arrays(found: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = joined(found)
    starts = np.array([o + f[1] for o, f in zip(offsets, found)])
    ends = np.array([o + f[2] for o, f in zip(offsets, found)])
    x = windows(data, offsets, np.arange(len(found)), starts, ends)
    return x, np.array([f[3] for f in found], dtype=np.float32)


def _view_arrays(found: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The views of the runs of long findings; those that hold a small part of a secret are left out."""
    data, offsets = joined(found)
    starts, ends = runs(data, offsets, _CANDIDATE, 2 * BODY)
    of, s, e = views(starts, ends)
    owner = np.searchsorted(offsets, s, side="right") - 1
    first, last, label = (np.array([f[i] for f in found])[owner] for i in (1, 2, 3))
    held = np.where(label == 1, np.minimum(e - offsets[owner], last) - np.maximum(s - offsets[owner], first), 0)
    clear = (held <= 0) | (held >= np.minimum(last - first, 20))
    x = windows(data, offsets, owner[clear], s[clear], e[clear])
    return x, (held[clear] > 0).astype(np.float32)


def table_findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled findings of documents (doc_id, text), with the text that a view reads: 1 for values of base findings of LEAST or more bytes, 0 for runs beside them without both a letter and a digit."""
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = buffer_of(batch.column("text"))
            base = base_findings(data, offsets)
            out = [(row, int(offsets[row]) + v, int(offsets[row]) + b, 1) for row, found in enumerate(base) for _, _, b, v in found if b - v >= LEAST]
            owner, starts, ends = _beside(*runs(data, offsets, _CANDIDATE, LEAST), offsets, base)
            for row, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist()):
                own = data[a:b]
                digit = (own >= 0x30) & (own < 0x3A)
                if not (digit.any() and (_ALNUM[own] & ~digit).any()):
                    out.append((row, a, b, 0))
            ids = batch.column("doc_id")
            made: list[tuple] = []
            for row, a, b, label in out:
                lo, hi = max(int(offsets[row]), a - CONTEXT), min(int(offsets[row + 1]), b + CONTEXT)
                made.append((ids[row].as_py(), data[lo:hi].tobytes(), a - lo, b - lo, label))
            columns = list(zip(*made)) if made else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "context", "start", "end", "label"])


@lru_cache(1)
def _generated() -> tuple[np.ndarray, np.ndarray]:
    """Views and labels of the generated findings to learn from, by themselves and in long runs."""
    x, y = map(np.concatenate, zip(_arrays(findings(1, 2000) + wordy(5, 800)), _view_arrays(long_findings(3, 200))))
    return x, y


def started(_: Iterator[pa.RecordBatch]) -> Network:
    """The network after training on generated findings."""
    net = Network()
    net.learn(*_generated())
    return net


def refined(start: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """start after training on labelled findings (views and labels): all of them, the secrets repeated to a quarter of the others, generated ones to half of them."""
    yes, no = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    own = np.resize(yes, max(len(yes), len(no) // 4)) if len(yes) else yes
    more_x, more_y = _generated()
    more = np.resize(np.arange(len(more_x)), max(len(more_x), len(x) // 2))
    net = Network()
    net.p = dict(start.p)
    rounds = int(np.clip(10_000 // max(1, len(x)), 1, 5))
    net.learn(np.concatenate([x[no], x[own], more_x[more]]), np.concatenate([y[no], y[own], more_y[more]]), rounds, rate=0.002)
    return net


def _refine(start: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many findings a part holds, and what the network is after training on them."""
    parts = [_arrays(_listed(batch)) for batch in batches if batch.num_rows]
    if parts:
        x, y = map(np.concatenate, zip(*parts))
        yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([pickle.dumps(refined(start, x, y).p)], pa.binary())], names=["n", "p"])


def _listed(batch: pa.RecordBatch) -> list[tuple[bytes, int, int, int]]:
    return list(zip(*(batch.column(c).to_pylist() for c in ("context", "start", "end", "label"))))


def _reached(net: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label and best score of each finding, the score as the bits of a float: those of positive floats are ordered like them."""
    for batch in batches:
        if batch.num_rows:
            p, y = best_scores(_listed(batch), net)
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(p.astype(np.float32).view(np.int32))], names=["label", "bits"])


def _own_scores(net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Best scores and labels of the generated findings that serve the limit."""
    return best_scores(findings(2, 1200) + wordy(6, 600) + long_findings(4, 200), net)


def fitted(docs: DataFrame, recall: float = 0.98, per_part: int = 20_000) -> Network:
    """The network for docs (doc_id, text): it learns from all labelled findings of documents and generated ones; documents with crc32(doc_id) mod 5 = 0 are only for the limit, set by all of theirs.

    After generated findings, parts of about per_part findings, by hash, are learnt by tasks of their own, each on from the
    same network; the mean of what they make of it, by findings, is the result. Always the same for the same findings.
    """
    found = bounded(docs).select("doc_id", "text").mapInArrow(tidied(table_findings), "doc_id long, context binary, start long, end long, label int")
    found = write_table(found.withColumn("held", (F.coalesce(remainder(5), F.lit(1)) == 0).cast("int")), "findings")
    net = fit(docs.sparkSession.range(1), started)
    own = found.where("held = 0")
    if n := own.count():
        order = [F.xxhash64("context", "doc_id", "start"), F.col("doc_id"), F.col("start"), F.col("context"), F.col("label")]
        parts = own.repartition(-(-n // per_part), "context", "doc_id", "start").sortWithinPartitions(*order)
        learnt = [(r.n, pickle.loads(r.p)) for r in parts.mapInArrow(tidied(partial(_refine, net)), "n long, p binary").collect()]
        net.p = {k: (sum(w * p[k].astype(np.float64) for w, p in learnt) / n).astype(np.float32) for k in net.p}
    p, y = _own_scores(net)
    reached = write_table(found.where("held = 1").mapInArrow(tidied(partial(_reached, net)), "label int, bits int"), "reached")
    bounds = []
    for label in (1, 0):
        bits = reached.where(F.col("label") == label).select("bits")
        generated = p[y == label].astype(np.float32).view(np.int32)
        at = place(bits.count() + len(generated), label, recall)
        bounds.append(float(np.array([least_but(bits, generated, at)], np.int32).view(np.float32)[0]))
    net.calibrate(*bounds)
    return net


@lru_cache(1)
def trained(recall: float = 0.98) -> Network:
    """The network without documents: from generated findings alone."""
    net = started(iter(()))
    p, y = _own_scores(net)
    net.calibrate(*(np.sort(p[y == label])[place(int((y == label).sum()), label, recall)] for label in (1, 0)))
    return net


def base_findings(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """Base findings of each text, as base_spans gives them; only texts that may hold one are searched."""
    n = len(offsets) - 1
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
    low = data.tobytes().translate(LOWER)
    rows = set()
    for w in _WORDS:
        at = low.find(w)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            rows.add(row)
            at = low.find(w, int(offsets[row + 1]))
    raw = data.tobytes()
    at = raw.find(b"AKIA")
    while at >= 0:
        row = int(np.searchsorted(offsets, at, side="right")) - 1
        rows.add(row)
        at = raw.find(b"AKIA", int(offsets[row + 1]))
    s, _ = runs(data, offsets, _HEX, 24)
    rows.update((np.searchsorted(offsets, s, side="right") - 1).tolist())
    for row in rows:
        out[row] = base_spans(raw[offsets[row] : offsets[row + 1]])
    return out


def _beside(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, base: list[list[tuple[int, int, int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of what base findings leave of each run, in pieces of LEAST or more bytes: one sweep over both, in order of starts."""
    shut: list[list[int]] = []
    for o in np.flatnonzero(np.fromiter(map(len, base), dtype=np.int64, count=len(base))).tolist():
        at = int(offsets[o])
        for a, _, b, _ in base[o]:
            if shut and at + a <= shut[-1][1]:
                shut[-1][1] = max(shut[-1][1], at + b)
            else:
                shut.append([at + a, at + b])
    out, k = [], 0
    for s, e, o in zip(starts.tolist(), ends.tolist(), (np.searchsorted(offsets, starts, side="right") - 1).tolist()):
        while k < len(shut) and shut[k][1] <= s:
            k += 1
        while k < len(shut) and shut[k][0] < e:
            out.append((o, s, shut[k][0]))
            s = shut[k][1]
            if s >= e:
                break
            k += 1
        out.append((o, s, e))
    owner, starts, ends = np.array(out, dtype=np.int64).reshape(-1, 3).T
    long = ends - starts >= LEAST
    return owner[long], starts[long], ends[long]


def _scored(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, net: Network) -> tuple[np.ndarray, ...]:
    """Number of the stretch, start, end and score of each view of stretches."""
    of, s, e = views(starts, ends)
    p = np.zeros(len(s))
    for at in range(0, len(s), 512):
        part = slice(at, at + 512)
        p[part], _ = net.forward(windows(data, offsets, owner[of[part]], s[part], e[part]))
    return of, s, e, p


def scores(data: np.ndarray, offsets: np.ndarray, base: list[list[tuple[int, int, int, int]]], net: Network) -> tuple[np.ndarray, ...]:
    """Text, candidate, start, end (in data) and score of every view of a candidate: each maximal run of LEAST or more bytes of _CANDIDATE beside base findings.

    Candidates are numbered; last come their ends, by number.
    """
    owner, starts, ends = _beside(*runs(data, offsets, _CANDIDATE, LEAST), offsets, base)
    of, s, e, p = _scored(data, offsets, owner, starts, ends, net)
    return owner[of], of, s, e, p, starts, ends


def scan(data: np.ndarray, offsets: np.ndarray, net: Network) -> list[list[tuple[int, int, int, float]]]:
    """Base findings and those of the network (kind 3) of each text, as (start, kind, end, score) in its bytes.

    Candidates: every base finding, and every maximal run of 12 or more letters, digits and + / _ = - . in the
    whole text beside them. The network scores them all; base findings stay whatever it says of their values. A
    candidate beyond 80 bytes is read in overlapping windows; its findings are the windows that reach the limit,
    joined where they touch, and to the ends of the letters and digits that they cut.
    """
    base = base_findings(data, offsets)
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in base]
    rows = np.array([row for row, found in enumerate(base) for _ in found], dtype=np.int64)
    if len(rows):
        flat = np.array([f for found in base for f in found], dtype=np.int64)
        best = np.zeros(len(rows))
        of, _, _, p = _scored(data, offsets, rows, flat[:, 3] + offsets[rows], flat[:, 2] + offsets[rows], net)
        np.maximum.at(best, of, p)
        for row, (a, k, b, _), score in zip(rows.tolist(), flat.tolist(), best.tolist()):
            out[row].append((a, k, b, score))
    owner, of, s, e, p, starts, ends = scores(data, offsets, base, net)
    last = -1
    for i in np.flatnonzero(p >= net.limit).tolist():
        o, c, a, b = int(owner[i]), int(of[i]), int(s[i]), int(e[i])
        while a > starts[c] and _ALNUM[data[a - 1]] and _ALNUM[data[a]]:
            a -= 1
        while b < ends[c] and _ALNUM[data[b]] and _ALNUM[data[b - 1]]:
            b += 1
        a, b, score = a - int(offsets[o]), b - int(offsets[o]), float(p[i])
        if c == last and out[o][-1][2] >= a:
            a, b, score = min(out[o][-1][0], a), max(out[o][-1][2], b), max(out[o][-1][3], score)
            out[o].pop()
        out[o].append((a, 3, b, score))
        last = c
    for found in out:
        found.sort()
    return out


def best_scores(found: list[tuple[str | bytes, int, int, int]], net: Network) -> tuple[np.ndarray, np.ndarray]:
    """The network's best score of each finding, as scan() sees it (0 where nothing does), and its label."""
    data, offsets = joined(found)
    base = base_findings(data, offsets)
    best = np.zeros(len(found))
    rows = np.array([row for row, own in enumerate(base) for _ in own], dtype=np.int64)
    flat = np.array([f for own in base for f in own], dtype=np.int64).reshape(-1, 4)
    of, s, e, p = _scored(data, offsets, rows, flat[:, 3] + offsets[rows], flat[:, 2] + offsets[rows], net)
    owner, _, s2, e2, p2 = scores(data, offsets, base, net)[:5]
    for o, s, e, p in zip(np.concatenate([rows[of], owner]).tolist(), np.concatenate([s, s2]).tolist(), np.concatenate([e, e2]).tolist(), np.concatenate([p, p2]).tolist()):
        if s - offsets[o] < found[o][2] and found[o][1] < e - offsets[o]:
            best[o] = max(best[o], p)
    return best, np.array([f[3] for f in found], dtype=np.float32)


_NAMES = (*KINDS, "network")
SPANS = "array<struct<start:long,kind:int,end:long,score:double>>"


def _scan(net, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("score", pa.float64())]))
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = buffer_of(batch.column("text"))
            spans = []
            for row, found in enumerate(scan(data, offsets, net.value)):
                if found:
                    points = code_points(data[offsets[row] : offsets[row + 1]], [x for s, _, e, _ in found for x in (s, e)]).tolist()
                    found = [{"start": points[2 * i], "kind": k, "end": points[2 * i + 1], "score": p} for i, (_, k, _, p) in enumerate(found)]
                spans.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])


def found_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text string and any columns but spans) with spans: code points and scores of all findings by start, then kind; none for null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", spans {SPANS}"
    return bounded(docs).mapInArrow(tidied(partial(_scan, docs.sparkSession.sparkContext.broadcast(fitted(docs)))), schema)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, scores for every row of docs (doc_id long, text string; others aren't read).

    Base findings always stay; the network adds spans of kind network. scores: what it gives to each span, in
    their order, with four decimals. Null and empty texts have none: counts of 0, the digest of the empty string, and
    empty spans. Rows with equal doc_id, or none, are separate.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = F.array(*map(F.lit, _NAMES))

    def written(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found_spans(own).select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] < len(KINDS))), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.concat_ws(",", F.transform("spans", lambda s: F.format_number(s["score"], 4))).alias("scores"),
    )


def _redact(mark: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            if spans:
                parts, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], mark]
                    at = max(at, s["end"])
                text = "".join([*parts, text[at:]])
            out.append(text)
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All documents (doc_id, text, lang, source, n_chars) with every finding replaced by mark; n_chars is counted anew where text changed."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source", "n_chars")
    found = found_spans(own)
    out = found.mapInArrow(tidied(partial(_redact, mark)), found.schema)
    return out.select("doc_id", "text", "lang", "source", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
