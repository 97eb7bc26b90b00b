"""Column expressions on years, weights, keys and values."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import UNK

MODEL_NAME = r"^w2v_y(\d+)_wb([A-Za-z_]+)_vs(\d+)_w(\d+)_mc(\d+)_sg([01])_e(\d+)"
#: Marks that stand for no word: three in either case, and the ends of texts.
SPECIAL = (*(f"<{x}>" for m in ("mask", "pad", "unk") for x in (m, m.upper())), *(f"<{x}>" for x in ("EOS", "BOS", "/S", "S")))


def year_bin(year: Column, size: int) -> Column:
    return year if size <= 1 else (year - F.pmod(year, F.lit(size))).cast("int")


def log_weight(count: Column, base: float = 5) -> Column:
    return F.greatest(F.lit(1), F.floor(F.log(count + 1) / F.log(F.lit(float(base))) + 1e-12).cast("int"))


def weight(strategy: str, occurrences: Column, documents: Column, base: float | None = None) -> Column:
    """How often a sentence counts: by occurrences (freq), documents (doc_freq), or once; damped by a log base if given."""
    raw = {"freq": occurrences, "doc_freq": documents}.get(strategy)
    if raw is None:
        return F.lit(1)
    return raw if base is None else log_weight(raw, base)


def unk_mode(tokens: Column, mode: str) -> Column:
    """Tokens after reject (null if any is unknown), strip (null if fewer than two remain) or retain."""
    unknown = F.array_contains(tokens, UNK)
    if mode == "reject":
        return F.when(~unknown, tokens)
    if mode == "strip":
        rest = F.array_remove(tokens, UNK)
        return F.when(F.size(rest) >= 2, rest)
    if mode == "retain":
        return tokens
    raise ValueError(f"unknown mode {mode!r}")


def year_key(year: Column, text: Column) -> Column:
    """Binary key: year in four bytes, high first, then the text: sorts by year, then text."""
    return F.concat(F.unhex(F.lpad(F.hex(year.cast("long")), 8, "0")), F.encode(text, "UTF-8"))


def key_year(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("int")


def key_text(key: Column) -> Column:
    return F.decode(F.substring(key, 5, 1 << 30), "UTF-8")


def shown_key(year: Column, text: Column, genre: Column | None = None) -> Column:
    body = F.concat(F.lit("["), year.cast("string"), F.lit("] "), text)
    return body if genre is None else F.concat(F.lit("["), genre, F.lit("]"), body)


def parsed_key(shown: Column) -> Column:
    """struct(genre, year, text) of '[genre][year] text' or '[year] text'; genre null in the latter, all but text in neither."""
    pattern = r"^(?:\[([^\]]*[^\]\d][^\]]*)\])?\[(\d+)\] (.*)$"
    hit = shown.rlike(pattern)
    part = lambda i: F.when(hit, F.nullif(F.regexp_extract(shown, pattern, i), F.lit("")))
    return F.struct(part(1).alias("genre"), part(2).cast("int").alias("year"), F.when(hit, F.regexp_extract(shown, pattern, 3)).otherwise(shown).alias("text"))


def shown_counts(freqs: Column, form: str = "summary", most: int = 10) -> Column:
    """Yearly counts as text: summary of all, or the last ones (packed)."""
    if form == "summary":
        total = lambda f: F.aggregate(freqs, F.lit(0).cast("long"), lambda a, x: a + x[f])
        return F.format_string("%d years, %d occurrences, %d documents", F.size(freqs), total("occurrences"), total("documents"))
    last = F.slice(freqs, F.greatest(F.size(freqs) - most + 1, F.lit(1)), most)
    return F.concat_ws("; ", F.transform(last, lambda x: F.concat_ws(":", x["year"].cast("string"), x["occurrences"].cast("string"), x["documents"].cast("string"))))


def model_parameters(name: Column) -> Column:
    part = lambda i: F.nullif(F.regexp_extract(name, MODEL_NAME, i), F.lit(""))
    return F.struct(
        part(1).cast("int").alias("year"), part(2).alias("weight_by"), part(3).cast("int").alias("vector_size"), part(4).cast("int").alias("window"),
        part(5).cast("int").alias("min_count"), part(6).cast("int").alias("sg"), part(7).cast("int").alias("epochs"),
    )


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def half_width(deviation: Column, n: Column, confidence: float | None = None) -> Column:
    """Standard error of a mean, or the half width of its normal confidence interval; 0 for a single value."""
    z = 1.0 if confidence is None else NormalDist().inv_cdf(0.5 + confidence / 2)
    return F.when(n > 1, F.lit(z) * deviation / F.sqrt(n)).otherwise(0.0)
