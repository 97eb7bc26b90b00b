"""Whole pipelines: acquire, filter, rank, pivot, prepare."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tokens as K
from ..operators import counts as C
from ..sources import files
from ..sources.scratch import write_table
from ..sources.tables import data_rows

#: Distinct tokens that a task may look up in memory (some 100 bytes each); beyond, tokens meet their table in a join.
LOOKUP = 500_000


@dataclass(frozen=True)
class FilterConfig:
    lower: str | None = "ascii"
    alpha_only: bool = True
    ascii_alpha_only: bool = True
    filter_short: bool = True
    min_len: int = 3
    stop_words: frozenset[str] = frozenset()
    lemmas: dict[str, str] = field(default_factory=dict)
    whitelist: frozenset[str] | None = None
    always_include: frozenset[str] = frozenset()
    min_context_tokens: int = 2
    bin_size: int = 1
    #: whether the unknown mark counts as a valid token of a sentence when a whitelist is applied
    unk_is_valid: bool = False


def _accepted(w: Column, cfg: FilterConfig) -> Column:
    if cfg.whitelist is not None:
        return K.member(w, cfg.whitelist | cfg.always_include)
    ok = F.lit(True)
    if cfg.alpha_only:
        ok &= K.is_alpha(w, cfg.ascii_alpha_only)
    if cfg.filter_short:
        ok &= ~K.is_short(w, cfg.min_len)
    if cfg.stop_words:
        ok &= ~K.member(w, cfg.stop_words)
    return ok


def sentence_token(t: Column, cfg: FilterConfig, listed: Column | None = None, lemma: Column | None = None) -> Column:
    """One sentence token: lower case, whitelist, checks unless always included, lemma last. listed and lemma stand for those of tables."""
    w = K.lowered(t, cfg.lower)
    kept = K.member(w, cfg.always_include)
    if listed is None:
        listed = F.lit(True) if cfg.whitelist is None else K.member(w, cfg.whitelist)
    checks = F.lit(True)
    if cfg.alpha_only:
        checks &= K.is_alpha(w, cfg.ascii_alpha_only)
    if cfg.filter_short:
        checks &= ~K.is_short(w, cfg.min_len)
    if cfg.stop_words:
        checks &= ~K.member(w, cfg.stop_words)
    return F.when(kept, w).when(listed & checks, F.coalesce(lemma, K.lemma(w, cfg.lemmas)) if lemma is not None else K.lemma(w, cfg.lemmas)).otherwise(K.UNK)


def _with_table(words: DataFrame, key: Column, table: DataFrame | None, token: str, value: Column) -> DataFrame:
    """words with value of the row of table whose token is key, else null; the distinct words of a corpus and lists of any size meet by a join."""
    if table is None:
        return words.withColumn(token, F.lit(None))
    own = table.groupBy(F.col("token").alias("_w")).agg(F.max(value).alias(token))
    return words.withColumn("_w", key).join(own, "_w", "left").drop("_w")


def _known(files: tuple[str, ...]) -> tuple[pa.Array, pa.Array]:
    """The tokens of a table's files, and what they become, the unknown mark behind the last; a worker keeps those of one table."""
    if files not in _HELD:
        _HELD.clear()
        tables = []
        for uri in files:
            system, path = pa.fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as file:
                tables.append(pq.read_table(file, columns=["t", "o"]))
        tokens, out = ([c.cast(pa.string()) for t in tables for c in t.column(name).chunks] for name in ("t", "o"))
        _HELD[files] = (pa.concat_arrays([*tokens, pa.array([], pa.string())]), pa.concat_arrays([*out, pa.array([K.UNK], pa.string())]))
    return _HELD[files]


def _swap(files: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, out = _known(files)
    for batch in batches:
        t = batch.column("_t")
        t = t.cast(pa.list_(pa.string())) if t.type != pa.list_(pa.string()) else t
        at = pc.fill_null(pc.index_in(t.flatten(), value_set=tokens), len(tokens))
        sizes = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns) if n != "_t"), pa.ListArray.from_arrays(pa.array(offsets), out.take(at))], names=[*(n for n in batch.schema.names if n != "_t"), "out"])


_HELD: dict[tuple[str, ...], tuple[pa.Array, pa.Array]] = {}


def converted(df: DataFrame, tokens: Column, table: Callable[[DataFrame], DataFrame], lookup: int = LOOKUP, alone: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with out: tokens as table converts them, the unknown mark for those it leaves out.

    table takes the distinct tokens (t), so each is converted once, and returns (t, o). Where at most lookup of them
    are known, tasks read their files and look them up in memory, without a shuffle or the driver. Beyond, each occurrence is
    converted by alone, what a token becomes where no list has a say; with lists occurrences are joined to the table,
    frequent ones spread over salts.
    """
    df = df.withColumn("_t", tokens)
    known = write_table(table(df.select(F.explode("_t").alias("t")).distinct()).where(F.col("o") != K.UNK).select("t", "o"), "tokens")
    if known.count() <= lookup:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_t") + ", out array<string>"
        return df.mapInArrow(partial(_swap, tuple(sorted(known.inputFiles()))), schema)
    if alone is not None:
        return df.withColumn("out", F.transform("_t", alone)).drop("_t")
    rest = [c for c in df.columns if c != "_t"]
    rows = write_table(df.withColumn("_id", F.monotonically_increasing_id()), "rows")
    salted = rows.select("_id", F.posexplode("_t").alias("_i", "t")).withColumn("_s", F.pmod(F.col("_id"), F.lit(SALTS)))
    spread = known.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = salted.join(spread, ["t", "_s"], "left").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("o", F.lit(K.UNK)).alias("o")))).alias("_l"))
    return rows.join(met, "_id", "left").select(*rest, F.coalesce(F.transform("_l", lambda s: s["o"]), F.array().cast("array<string>")).alias("out"))


#: Parts that the occurrences of a token are split into where they are joined.
SALTS = 16


def filter_ngrams(counts: DataFrame, cfg: FilterConfig, whitelist: DataFrame | None = None, lemmas: DataFrame | None = None, lookup: int = LOOKUP) -> DataFrame:
    """Counts by year and n-gram after every token passed the filter; n-grams with too few known tokens go, equal ones add up.

    A long whitelist (token) or list of lemmas (token, lemma) is given as a table instead of in cfg, always_include
    then counts too.
    """

    def table(words: DataFrame) -> DataFrame:
        w = words.withColumn("_p", K.lowered(K.word_part(F.col("t")), cfg.lower))
        w = _with_table(w, F.col("_p"), lemmas, "_l", F.col("lemma") if lemmas is not None else F.lit(None))
        w = w.withColumn("_p", F.coalesce("_l", K.lemma(F.col("_p"), cfg.lemmas)))
        if whitelist is None:
            return w.select("t", F.when(_accepted(F.col("_p"), cfg), F.col("_p")).otherwise(K.UNK).alias("o"))
        w = _with_table(w, F.col("_p"), whitelist, "_k", F.lit(True))
        return w.select("t", F.when(F.coalesce("_k", F.lit(False)) | K.member(F.col("_p"), cfg.always_include), F.col("_p")).otherwise(K.UNK).alias("o"))

    def alone(t: Column) -> Column:
        p = K.lemma(K.lowered(K.word_part(t), cfg.lower), cfg.lemmas)
        return F.when(_accepted(p, cfg), p).otherwise(K.UNK)

    out = converted(counts.select("year", "occurrences", "documents", "ngram"), K.split_words(F.col("ngram")), table, lookup, alone if whitelist is None and lemmas is None else None)
    out = out.where((K.known_tokens(F.col("out")) >= cfg.min_context_tokens) & (F.size("out") > 0))
    return out.groupBy(S.year_bin(F.col("year"), cfg.bin_size).alias("year"), F.array_join("out", " ").alias("ngram")).agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def filter_sentences(sentences: DataFrame, cfg: FilterConfig, whitelist: DataFrame | None = None, lemmas: DataFrame | None = None, lookup: int = LOOKUP) -> DataFrame:
    """Counts by genre, year and sentence after the filter; sentences with fewer than two known tokens go.

    A long whitelist (token) or list of lemmas (token, lemma) is given as a table instead of in cfg.
    """

    def table(words: DataFrame) -> DataFrame:
        w = K.lowered(F.col("t"), cfg.lower)
        own = _with_table(words, w, whitelist, "_k", F.lit(True))
        own = _with_table(own, w, lemmas, "_l", F.col("lemma") if lemmas is not None else F.lit(None))
        return own.select("t", sentence_token(F.col("t"), cfg, F.coalesce("_k", F.lit(False)) if whitelist is not None else None, F.col("_l") if lemmas is not None else None).alias("o"))

    alone = None if whitelist is not None or lemmas is not None else lambda t: sentence_token(t, cfg)
    out = converted(sentences.select("genre", "year", "occurrences", "documents", "sentence"), K.split_words(F.col("sentence")), table, lookup, alone)
    valid = F.size("out") if cfg.unk_is_valid and (cfg.whitelist is not None or whitelist is not None) else K.known_tokens(F.col("out"))
    out = out.where(valid >= 2)
    return out.groupBy("genre", "year", F.array_join("out", " ").alias("sentence")).agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def ingest_ngrams(lines: DataFrame, kind: str = "all", pairs: Iterable[str] = ()) -> DataFrame:
    """Counts by year and n-gram of raw lines (value); n-grams that become equal when pairs are joined add up."""
    pairs = list(pairs)
    join = (lambda c: F.array_join(K.join_pairs(F.split(c, " "), pairs), " ")) if pairs else None
    rows = lines.select(K.parse_line(F.col("value"), join).alias("r")).where("r is not null").select("r.ngram", "r.freqs")
    rows = data_rows(rows.where(K.ngram_kind(F.col("ngram"), kind)), "ngram")
    return C.pivot_years(rows).groupBy("year", "ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def read_ngrams(spark: SparkSession, paths: str | list[str], kind: str = "all", pairs: Iterable[str] = ()) -> DataFrame:
    return ingest_ngrams(files.gzip_lines(spark, paths), kind, pairs)


def ingest_sentences(docs: DataFrame, pairs: Iterable[str] = (), min_tokens: int = 2, genres: list[str] | None = None, bin_size: int = 1) -> DataFrame:
    """genre, year, sentence, occurrences, documents (how many texts hold it) of texts (doc_id, text, year, genre)."""
    genre = F.coalesce("genre", F.lit("unknown"))
    d = docs.select("doc_id", genre.alias("genre"), S.year_bin(F.col("year"), bin_size).alias("year"), "text")
    if genres is not None:
        d = d.where(F.col("genre").isin(genres))
    s = d.select("doc_id", "genre", "year", F.explode(K.sentences(F.col("text"))).alias("s"))
    t = K.sentence_tokens(F.col("s"))
    if pairs:
        t = K.join_pairs(t, pairs, tagged=False, ignore_case=True)
    s = s.select("doc_id", "genre", "year", t.alias("t")).where(F.size("t") >= max(2, min_tokens)).select("doc_id", "genre", "year", F.array_join("t", " ").alias("sentence"))
    # by document first: what repeats within one counts once as a document
    one = s.groupBy("doc_id", "genre", "year", "sentence").agg(F.count("*").alias("n"))
    return one.groupBy("genre", "year", "sentence").agg(F.sum("n").cast("long").alias("occurrences"), F.count("*").alias("documents"))


def ngram_whitelist(counts: DataFrame, top_n: int | None = None, min_count: int = 1, years: tuple[int, int] | None = None, bin_size: int = 1, dictionary: DataFrame | None = None) -> DataFrame:
    """token, total: the most frequent n-grams that occur in every year of a range."""
    own = data_rows(counts, "ngram")
    if years:
        own = own.join(C.covers_all(own, *years, bin_size), "ngram", "left_semi")
    t = C.totals(own).withColumnRenamed("ngram", "token").where(F.col("total") >= min_count)
    t = C.spell_checked(t, dictionary)
    return C.ranked(t) if top_n is None else C.top(t, top_n)


def sentence_whitelist(sentences: DataFrame, top_n: int | None = None, min_count: int = 1, years: tuple[int, int] | None = None, always: Iterable[str] = (), dictionary: DataFrame | None = None) -> DataFrame:
    """token, total of words that occur in every year that the corpus has of a range; always-included words are added with their total or 0."""
    tokens = sentences.select("year", F.explode(K.split_words(F.col("sentence"))).alias("token"), "occurrences").where(F.col("token") != K.UNK)
    # read twice or more below, and much smaller than what it is made of
    yearly = write_table(tokens.groupBy("year", "token").agg(F.sum("occurrences").alias("occurrences")), "yearly")
    t = C.totals(yearly, "token", *(years or ()))
    every = t
    if years:
        t = t.join(C.covers_corpus(yearly, *years, "token"), "token", "left_semi")
    t = C.spell_checked(t.where(F.col("total") >= min_count), dictionary)
    forced = sentences.sparkSession.createDataFrame([(w,) for w in sorted(set(always))], "token string")
    best = t if top_n is None else C.top(t, top_n)
    missing = forced.join(best, "token", "left_anti").join(every, "token", "left").select("token", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    return C.ranked(best.select("token", "total").unionByName(missing))


def filter_corpus(sentences: DataFrame, cfg: FilterConfig, top_n: int | None, years: tuple[int, int] | None = None, lemmas: DataFrame | None = None, lookup: int = LOOKUP) -> DataFrame:
    """Filter, rank the words that remain, and filter again by that list, of any length; the first result is written, since both later steps read it."""
    first = write_table(filter_sentences(sentences, cfg, lemmas=lemmas, lookup=lookup), "filtered")
    words = write_table(sentence_whitelist(first, top_n, 1, years, cfg.always_include), "whitelist")
    again = FilterConfig(lower=None, alpha_only=False, filter_short=False, always_include=cfg.always_include, unk_is_valid=cfg.unk_is_valid)
    return filter_sentences(first, again, words.select("token"), lookup=lookup)


def observed(df: DataFrame, step: str, kept: Column) -> tuple[DataFrame, Observation]:
    """The rows of df that are kept, and what counts them and those read as they pass: no job of its own."""
    seen = Observation(step)
    marked = df.withColumn("_kept", F.coalesce(kept, F.lit(False))).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_kept").alias("kept"))
    return marked.where("_kept").drop("_kept"), seen


def observations(spark: SparkSession, seen: Iterable[Observation]) -> DataFrame:
    """step, rows, kept, share of steps whose results were asked for."""
    rows = [(o._name, o.get["rows"], o.get["kept"]) for o in seen]
    share = F.round(F.col("kept") / F.nullif(F.col("rows"), F.lit(0)), 6)
    return spark.createDataFrame(rows, "step string, rows long, kept long").withColumn("share", share)


def training_corpus(counts: DataFrame, unk: str = "reject", by: str = "freq", base: float | None = 5, text: str = "ngram") -> DataFrame:
    """year, tokens, weight of the n-grams or sentences that the treatment of unknown tokens leaves."""
    t = S.unk_mode(K.split_words(F.col(text)), unk)
    return counts.select("year", t.alias("tokens"), S.weight(by, F.col("occurrences"), F.col("documents"), base).cast("int").alias("weight")).where("tokens is not null")


def resume(write: str) -> str:
    """Spark's write mode for restart (all anew), resume (add what is missing, see unprocessed) and reprocess (all anew from the same input)."""
    return {"restart": "overwrite", "new": "overwrite", "reprocess": "overwrite", "resume": "append"}[write]
