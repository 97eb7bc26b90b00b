"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_batch(df: DataFrame, path: str, files: DataFrame, marks: str) -> None:
    """Append rows, then the names of the files they came from: what has no mark is read again."""
    df.write.mode("append").parquet(path)
    files.select("file").distinct().write.mode("append").parquet(marks)


def write_whitelist(whitelist: DataFrame, path: str, sep: str = "\t") -> None:
    """One file of token, sep, total, the most frequent first. A whitelist is a vocabulary of bounded size."""
    ranked = whitelist.orderBy(F.col("total").desc(), "token").select(F.concat_ws(sep, "token", F.col("total").cast("string")).alias("value"))
    ranked.coalesce(1).write.mode("overwrite").text(path)


def corpus_lines(corpus: DataFrame) -> DataFrame:
    """A line of tokens for each sentence, as often as its weight says."""
    return corpus.select(F.explode(F.array_repeat(F.array_join("tokens", " "), F.col("weight").cast("int"))).alias("value"))


def write_corpus(corpus: DataFrame, path: str) -> None:
    corpus_lines(corpus).write.mode("overwrite").option("compression", "gzip").text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.repartitionByRange("year", "word").sortWithinPartitions("year", "word").write.mode("overwrite").partitionBy("year").parquet(path)


def write_results(results: DataFrame, path: str, append: bool = True) -> None:
    results.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def write_stats(stats: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Written unless it is there already; what is there is returned."""
    stats.coalesce(1).write.mode("overwrite" if overwrite else "ignore").option("header", True).csv(path)
    return stats.sparkSession.read.schema(stats.schema).option("header", True).csv(path)


def compact(df: DataFrame, path: str, files: int) -> None:
    df.coalesce(files).write.mode("overwrite").option("compression", "zstd").parquet(path)


def selected_models(vectors: DataFrame, **chosen) -> DataFrame:
    """Rows of models whose parameters are as chosen: a value, or a set of values, for each."""
    for k, v in chosen.items():
        vectors = vectors.where(F.col(k).isin(sorted(v)) if isinstance(v, (set, list, tuple)) else F.col(k) == v)
    return vectors
