"""Reading and writing count tables: Parquet in partitions by year stands where a key-value store would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import LONG
from .scratch import write_table

MARK = "__"


def write_long(counts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One sorted run of n-grams a year: a year's range of keys is a folder, an n-gram's a few row groups."""
    counts.repartitionByRange("year", "ngram").sortWithinPartitions("year", "ngram").write.mode(mode).partitionBy("year").option("compression", "zstd").parquet(path)


def read_long(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LONG).parquet(path)


def range_scan(df: DataFrame, key: str, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Rows with lower <= key < upper in byte order of UTF-8, which is how Spark compares strings."""
    if not all(x is None or isinstance(x, str) for x in (lower, upper)):
        raise TypeError("bounds are strings")
    if lower is not None:
        df = df.where(F.col(key) >= lower)
    return df if upper is None else df.where(F.col(key) < upper)


def prefix_scan(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(F.col(key).startswith(prefix))


def data_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't one of a job's marks."""
    return df.where(~F.col(key).startswith(MARK))


def _year(year: int) -> int:
    if not 0 <= year <= 9999:
        raise ValueError(f"year {year} is outside 0..9999")
    return year


def ngram_stats(counts: DataFrame, year: int, ngram: str) -> DataFrame:
    """occurrences and documents of one n-gram in one year; no row where it doesn't occur."""
    return counts.where((F.col("year") == _year(year)) & (F.col("ngram") == ngram)).select("occurrences", "documents")


def year_scan(counts: DataFrame, year: int, predicate: Column | None = None) -> DataFrame:
    out = counts.where(F.col("year") == _year(year)).select("ngram", "occurrences", "documents")
    return out if predicate is None else out.where(predicate)


def year_range_scan(counts: DataFrame, first: int, last: int, predicate: Column | None = None) -> DataFrame:
    """Both years included."""
    out = counts.where(F.col("year").between(_year(first), _year(last)))
    return out if predicate is None else out.where(predicate)


def head(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def tail(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The last n rows, the last first."""
    return df.orderBy(*(F.col(k).desc() for k in keys)).limit(n)


def numbered(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """df with places from 0 in the order of keys, by range partitions and their sizes: no task gets all rows.

    The sorted run is written first: read twice, once for the sizes of its partitions, it must not be sampled twice.
    """
    run = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    run = write_table(run, "run")
    sizes = run.groupBy("_part").agg(F.count("*").alias("_size"))
    base = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return run.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def every_nth(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Every n-th row in the order of keys, from the first."""
    return numbered(df, *keys, name="_n").where(F.col("_n") % n == 0).drop("_n")


def item_counts(df: DataFrame, group: Column | None = None) -> DataFrame:
    """Rows by group, null as unknown; all rows where no group is given."""
    if group is None:
        return df.agg(F.count("*").alias("items"))
    return df.groupBy(F.coalesce(group.cast("string"), F.lit("unknown")).alias("grp")).agg(F.count("*").alias("items"))


def by_year(year: Column) -> Column:
    """The year where it is one, else null: for item_counts."""
    return F.when((year > 0) & (year < 10000), year)


def by_pattern(key: Column, pattern: str) -> Column:
    """The first group of pattern, or the whole match where it has none; null without a match."""
    group = 1 if "(" in pattern.replace(r"\(", "").replace("(?", "") else 0
    return F.when(key.rlike(pattern), F.regexp_extract(key, pattern, group))


def upsert_sum(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rule for equal keys: occurrences and documents of an n-gram and year add up."""
    return old.unionByName(new).groupBy("year", "ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def unprocessed(files: DataFrame, done: DataFrame, name: str = "file") -> DataFrame:
    return files.join(done.select(name), name, "left_anti")


def file_subset(files: DataFrame, first: int, last: int, name: str = "file") -> DataFrame:
    """Files first to last (from 0, both included) by name; ValueError if they aren't all there. Lists of files are small."""
    n = files.count()
    if not 0 <= first <= last < n:
        raise ValueError(f"range {first}..{last} isn't within 0..{n - 1}")
    place = F.row_number().over(Window.orderBy(name)) - 1
    return files.withColumn("_n", place).where(F.col("_n").between(first, last)).drop("_n")


def shuffled_files(files: DataFrame, seed: int, name: str = "file") -> DataFrame:
    return files.orderBy(F.xxhash64(name, F.lit(seed)), name)
