"""Column expressions on tokens, n-grams and sentences: all stay within generated JVM code."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNK = "<UNK>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAGS = tuple("ADJ ADP ADV CONJ DET NOUN NUM PRON PROPN VERB X .".split())
_TAG = "|".join(t.replace(".", r"\.") for t in TAGS)
UNIVERSAL = {"CONJ": "CCONJ", ".": "PUNCT"}
PUNCTUATION = r"""^[-@'":;,?!.]+$"""


def ascii_lower(c: Column) -> Column:
    """A-Z as a-z; every other letter stays."""
    return F.translate(c, UPPER, LOWER)


def lowered(c: Column, how: str | None) -> Column:
    if how is None:
        return c
    return {"ascii": ascii_lower, "unicode": F.lower}[how](c)


def is_alpha(c: Column, ascii_only: bool = True) -> Column:
    return c.rlike("^[A-Za-z]+$") if ascii_only else c.rlike(r"^\p{L}+$")


def is_short(c: Column, least: int) -> Column:
    """Fewer than least bytes of UTF-8."""
    return F.octet_length(c) < least


def member(c: Column, words: Iterable[str]) -> Column:
    words = sorted(set(words))
    return c.isin(words) if words else F.lit(False)


def ngram_kind(ngram: Column, kind: str) -> Column:
    """all: not blank; tagged: each token ends in a part-of-speech tag; untagged: none does."""
    tagged = lambda t: t.rlike(f"_({_TAG})$")
    tokens = F.split(ngram, " ")
    filled = F.trim(ngram) != ""
    if kind == "all":
        return filled
    if kind == "tagged":
        return filled & F.forall(tokens, tagged)
    if kind == "untagged":
        return filled & F.forall(tokens, lambda t: ~tagged(t))
    raise ValueError(f"unknown kind {kind!r}")


def word_part(token: Column) -> Column:
    """The token without a valid tag at its end; a tag alone is a word."""
    return F.coalesce(F.nullif(F.regexp_extract(token, f"^(.+)_({_TAG})$", 1), F.lit("")), token)


def tag_part(token: Column) -> Column:
    return F.nullif(F.regexp_extract(token, f"^(.+)_({_TAG})$", 2), F.lit(""))


def universal_tag(tag: Column) -> Column:
    """The tag in the universal set; unknown and missing ones are NOUN."""
    out = F.when(tag.isin([t for t in TAGS if t not in UNIVERSAL]), tag)
    for k, v in UNIVERSAL.items():
        out = out.when(tag == k, v)
    return out.otherwise("NOUN")


def join_pairs(tokens: Column, pairs: Iterable[str], tagged: bool = True, ignore_case: bool = False) -> Column:
    """Tokens with listed two-word terms joined by a hyphen, greedily from the left.

    tagged: what follows a token's last underscore doesn't count in a match, and the joined token keeps that of
    the first. ignore_case: case doesn't count, and stays as it is.
    """
    wanted = sorted({p.lower() if ignore_case else p for p in pairs})
    if not wanted:
        return tokens
    stem = (lambda t: F.regexp_replace(t, "_[^_]*$", "")) if tagged else (lambda t: t)
    same = F.lower if ignore_case else (lambda t: t)

    def step(acc: Column, k: Column) -> Column:
        here, there = F.element_at(tokens, k), F.try_element_at(tokens, k + 1)
        hit = F.coalesce(same(F.concat(stem(here), F.lit(" "), stem(there))).isin(wanted), F.lit(False))
        suffix = F.substring(here, F.length(stem(here)) + 1, F.length(here)) if tagged else F.lit("")
        joined = F.concat(stem(here), F.lit("-"), stem(there), suffix)
        return (
            F.when(acc["skip"], F.struct(acc["out"].alias("out"), F.lit(False).alias("skip")))
            .when(hit, F.struct(F.concat(acc["out"], F.array(joined)).alias("out"), F.lit(True).alias("skip")))
            .otherwise(F.struct(F.concat(acc["out"], F.array(here)).alias("out"), F.lit(False).alias("skip")))
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))
    return F.when(F.size(tokens) < 2, tokens).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(tokens)), start, step, lambda acc: acc["out"]))


def parse_line(line: Column, prepare: Callable[[Column], Column] | None = None) -> Column:
    """struct(ngram, freqs) of a line 'ngram TAB year,matches,volumes TAB ...'; null without an n-gram or a valid triple."""
    parts = F.split(line, "\t")
    ngram = F.element_at(parts, 1)
    triples = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, ","))

    def number(t: Column, i: int) -> Column:
        return F.element_at(t, i).try_cast("long")

    valid = F.filter(triples, lambda t: F.coalesce((F.size(t) == 3) & F.forall(t, lambda x: x.try_cast("long").isNotNull()), F.lit(False)))
    freqs = F.transform(valid, lambda t: F.struct(number(t, 1).cast("int").alias("year"), number(t, 2).alias("occurrences"), number(t, 3).alias("documents")))
    return F.when((F.trim(ngram) != "") & (F.size(freqs) > 0), F.struct((prepare(ngram) if prepare else ngram).alias("ngram"), freqs.alias("freqs")))


def split_words(text: Column) -> Column:
    """Tokens between runs of blanks."""
    return F.filter(F.split(text, " +"), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Runs of text with the marks . ! ? that end them."""
    return F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]+|[^.!?]+"), F.lit(0))


def sentence_tokens(sentence: Column) -> Column:
    """Tokens between white space, without those of punctuation alone."""
    return F.filter(F.split(sentence, r"(?U)\s+"), lambda t: (t != "") & ~t.rlike(PUNCTUATION))


def lemma(token: Column, table: dict[str, str] | None) -> Column:
    """The lemma that table has for token, else token itself."""
    if not table:
        return token
    known = F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair))
    return F.coalesce(F.element_at(known, token), token)


def known_tokens(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t != UNK))
