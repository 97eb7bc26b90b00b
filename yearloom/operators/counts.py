"""Counting, coverage, ranking and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import year_bin
from ..functions.tokens import UNK


def widen(counts: DataFrame) -> DataFrame:
    """year, ngram, occurrences, documents as one row an n-gram with its counts by year."""
    one = F.struct("year", "occurrences", "documents")
    return counts.groupBy("ngram").agg(F.array_sort(F.collect_list(one)).alias("freqs"))


def pivot_years(wide: DataFrame, check: bool = False) -> DataFrame:
    """One row an n-gram and year. With check, years outside 0..9999 are an error; otherwise such rows are left out."""
    rows = wide.select("ngram", F.explode("freqs").alias("f")).select(F.col("f.year").alias("year"), "ngram", F.col("f.occurrences").alias("occurrences"), F.col("f.documents").alias("documents"))
    fine = F.coalesce(F.col("year").between(0, 9999), F.lit(False))
    if check:
        return rows.withColumn("year", F.when(fine, F.col("year")).otherwise(F.raise_error(F.concat(F.lit("bad year for "), F.col("ngram"))).cast("int")))
    return rows.where(fine)


def bin_years(counts: DataFrame, size: int) -> DataFrame:
    return counts.groupBy("ngram", year_bin(F.col("year"), size).alias("year")).agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def total(freqs: Column, field: str = "occurrences") -> Column:
    return F.aggregate(freqs, F.lit(0).cast("long"), lambda a, x: a + x[field])


def totals(counts: DataFrame, key: str = "ngram", first: int | None = None, last: int | None = None) -> DataFrame:
    """Occurrences by key; with years given, those within them."""
    value = F.col("occurrences")
    if first is not None:
        value = F.when(F.col("year").between(first, last), value).otherwise(0)
    return counts.groupBy(key).agg(F.sum(value).cast("long").alias("total"))


def token_totals(sentences: DataFrame, tokens: Column, dictionary: DataFrame | None = None) -> DataFrame:
    """token, total over every place of a sentence, unknown ones left out; only words of the dictionary (word) if one is given."""
    out = sentences.select(F.explode(tokens).alias("token"), "occurrences").where(F.col("token") != UNK).groupBy("token").agg(F.sum("occurrences").cast("long").alias("total"))
    return out if dictionary is None else out.join(dictionary.select(F.col("word").alias("token")).distinct(), "token", "left_semi")


def covers_all(counts: DataFrame, first: int, last: int, size: int = 1, key: str = "ngram") -> DataFrame:
    """Keys that occur in every calendar year, or every bin, from first to last."""
    wanted = len({y - y % size for y in range(first, last + 1)})
    own = counts.where(F.col("year").between(first - first % size, last)).groupBy(key).agg(F.countDistinct(year_bin(F.col("year"), size)).alias("n"))
    return own.where(F.col("n") == wanted).select(key)


def covers_corpus(counts: DataFrame, first: int, last: int, key: str = "ngram") -> DataFrame:
    """Keys that occur in every year from first to last in which anything does."""
    own = counts.where(F.col("year").between(first, last))
    wanted = own.agg(F.countDistinct("year").alias("wanted"))
    return own.groupBy(key).agg(F.countDistinct("year").alias("n")).join(F.broadcast(wanted), F.col("n") == F.col("wanted")).select(key)


def top(df: DataFrame, k: int, value: str = "total", key: str = "token") -> DataFrame:
    """The k greatest; ties by key."""
    return df.orderBy(F.col(value).desc(), F.col(key)).limit(k)


def ranked(df: DataFrame, value: str = "total", key: str = "token") -> DataFrame:
    return df.orderBy(F.col(value).desc(), F.col(key))


def top_with(df: DataFrame, k: int, forced: DataFrame, value: str = "total", key: str = "token") -> DataFrame:
    """The k greatest, and the forced keys that aren't among them, with their value or 0."""
    best = top(df, k, value, key)
    missing = forced.select(key).distinct().join(best, key, "left_anti").join(df.select(key, value), key, "left").select(key, F.coalesce(value, F.lit(0)).cast("long").alias(value))
    return best.select(key, value).unionByName(missing)


def sample_per_group(df: DataFrame, group: str, k: int, seed: int, *keys: str) -> DataFrame:
    """k rows of each group, chosen by a hash of their keys and the seed, however they are partitioned.

    Each task first keeps its own k of a group, so that a large group is no large partition.
    """
    h = df.withColumn("_h", F.xxhash64(*keys, F.lit(seed)))
    local = Window.partitionBy(group, "_s").orderBy("_h", *keys)
    own = h.withColumn("_s", F.pmod(F.hash("_h"), F.lit(32))).withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k)
    return own.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h", *keys))).where(F.col("_r") <= k).drop("_h", "_s", "_r")


def boundaries(df: DataFrame, key: str, units: int, accuracy: int = 10000) -> DataFrame:
    """Bounds that cut a numeric key into units of about equal numbers of rows."""
    at = [i / units for i in range(1, units)]
    return df.agg(F.percentile_approx(key, at, accuracy).alias("b")).select(F.posexplode("b").alias("unit", "bound"))


def status_counts(work: DataFrame) -> DataFrame:
    """Units by status; those that were split count as their parts."""
    return work.join(work.where("parent is not null").select(F.col("parent").alias("unit_id")).distinct(), "unit_id", "left_anti").groupBy("status").agg(F.count("*").alias("units"))


def kept_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.agg(F.count("*").alias("scanned")), after.agg(F.count("*").alias("kept"))
    return a.crossJoin(b).withColumn("ratio", F.col("kept") / F.greatest("scanned", F.lit(1)))


def ingest_summary(files: DataFrame) -> DataFrame:
    """Of files (ok boolean, entries, bytes, seconds): counts, entries, and rates."""
    s = F.greatest(F.sum("seconds"), F.lit(1e-9))
    return files.agg(
        F.count_if("ok").alias("files_ok"), F.count_if(~F.col("ok")).alias("files_failed"), F.sum("entries").cast("long").alias("entries"),
        (F.sum("bytes") / 1e6 / s).alias("mb_per_second"), F.avg("seconds").alias("seconds_per_file"), (F.count("*") * 3600 / s).alias("files_per_hour"),
    )


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    if unknown := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {unknown}")
    return df.dropna(subset=list(columns))


def spell_checked(words: DataFrame, dictionary: DataFrame | None, alpha_only: bool = True) -> DataFrame:
    """words (token) that are letters and in the dictionary (word). Without alpha_only, tokens of other characters pass. No dictionary: all pass."""
    if dictionary is None:
        return words
    known = dictionary.select(F.col("word").alias("token")).distinct().withColumn("_k", F.lit(True))
    alpha = F.col("token").rlike(r"^\p{L}+$")
    return words.join(known, "token", "left").where(F.coalesce("_k", F.lit(False)) & alpha | (F.lit(not alpha_only) & ~alpha)).drop("_k")
