"""Files of n-grams, corpora, word lists and models."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RELEASES = {
    "20120701": r"googlebooks-{corpus}-all-{n}gram-20120701-[a-z0-9_]+\.gz",
    "20200217": r"{n}-[0-9]{{5}}-of-[0-9]{{5}}\.gz",
    "20090715": r"googlebooks-{corpus}-all-{n}gram-20090715-[0-9]+\.csv\.zip",
}
ARCHIVE_YEAR = r"text_(\d{4})s?_"
DOC_NAME = r"^([a-z]+)_(\d{4})_\d+\.txt$"
MARKER = r"^\s*(?:@@|##)(\d+)"


def location(base: str, n: int, release: str, corpus: str) -> tuple[str, re.Pattern]:
    """The folder of a release's files of n-grams, and the pattern of their names. base is whatever mirror holds them."""
    if n not in range(1, 6):
        raise ValueError("n is 1 to 5")
    if not re.fullmatch(r"\d{8}", release) or release not in RELEASES:
        raise ValueError(f"no release {release!r}")
    if not re.fullmatch(r"[A-Za-z0-9-]+", corpus):
        raise ValueError(f"no corpus {corpus!r}")
    return f"{base.rstrip('/')}/{release}/{corpus}/{n}gram", re.compile(RELEASES[release].format(n=n, corpus=re.escape(corpus)))


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Names of the files in a folder, sorted and distinct; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path").distinct().withColumn("file", F.element_at(F.split("path", "/"), -1)).orderBy("file")


def gzip_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files, decompressed by name; malformed UTF-8 becomes replacement characters."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file"))


def archive_year(path: Column, pattern: str = ARCHIVE_YEAR, other: str | None = None) -> Column:
    """The year in an archive's name; an error where neither pattern finds one."""
    year = F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    if other:
        year = F.coalesce(year, F.nullif(F.regexp_extract(path, other, 1), F.lit("")))
    return F.when(year.isNull(), F.raise_error(F.concat(F.lit("no year in "), path)).cast("int")).otherwise(year.cast("int"))


def doc_genre(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, DOC_NAME, 1), F.lit(""))


def doc_year(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, DOC_NAME, 2), F.lit("")).cast("int")


def text_id(text: Column) -> Column:
    """The number behind @@ or ## at the start of a text."""
    return F.nullif(F.regexp_extract(text, MARKER, 1), F.lit("")).cast("long")


def without_marker(text: Column) -> Column:
    """The text without a first line that holds a marker."""
    return F.when(text.rlike(MARKER), F.regexp_replace(text, r"^\s*(?:@@|##)[^\n]*\n?", "")).otherwise(text)


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(z.namelist()):
                    if name.endswith(".txt"):
                        yield pd.DataFrame({"path": [path], "member": [name.rsplit("/", 1)[-1]], "content": [z.read(name).decode("utf-8", "replace")]})


def zip_documents(spark: SparkSession, folder: str, glob: str = "text_*.zip") -> DataFrame:
    """path, member, content, text_id of the text files in a folder's archives; content without the marker line, blank ones dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no {glob} in {folder}")
    return zip_members(files)


def zip_members(files: DataFrame, blank: bool = False) -> DataFrame:
    """path, member, content, text_id of the text files in archives (path, content: an archive of less than 2 GiB); content without the marker line, blank ones dropped unless asked for."""
    docs = files.select("path", "content").mapInPandas(_members, "path string, member string, content string")
    docs = docs.withColumn("text_id", text_id(F.col("content"))).withColumn("content", without_marker(F.col("content")))
    return docs if blank else docs.where(F.trim("content") != "")


def described(docs: DataFrame, metadata: DataFrame, archive: Column | None = None) -> DataFrame:
    """docs (text_id, member) with year and genre: from metadata, else from the member's name, else (year) from the archive's."""
    known = metadata.select("text_id", F.col("year").alias("_year"), F.col("genre").alias("_genre"))
    fallback = [doc_year(F.col("member"))] + ([archive] if archive is not None else [])
    return docs.join(known, "text_id", "left").withColumn("year", F.coalesce("_year", *fallback)).withColumn("genre", F.coalesce("_genre", doc_genre(F.col("member")))).drop("_year", "_genre")


def corpus_stats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per file of JSON lines {freq, doc}, its stem the year: year, unique_ngrams, total_freq, total_docs; absent fields are 0."""
    rows = spark.read.schema("freq long, doc long").json(paths).withColumn("year", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("int"))
    return stats_by_year(rows)


def stats_by_year(rows: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("year").agg(F.count("*").alias("unique_ngrams"), zero("freq").alias("total_freq"), zero("doc").alias("total_docs"))


def parse_whitelist(lines: DataFrame, top_n: int | None = None, min_count: int = 1, sep: str = "\t") -> DataFrame:
    """token, total of lines (value, and n, its place in the file): the first top_n lines, then those of at least min_count; malformed ones don't count."""
    if top_n is not None:
        lines = lines.where(F.col("n") < top_n)
    parts = F.split("value", re.escape(sep))
    out = lines.select(F.element_at(parts, 1).alias("token"), F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(2))).try_cast("long").alias("total"))
    return out.where((F.col("token") != "") & (F.col("total") >= min_count))


def read_whitelist(spark: SparkSession, path: str, top_n: int | None = None, min_count: int = 1, sep: str = "\t") -> DataFrame:
    """A list written by sinks.write_whitelist: one file, whose lines Spark reads in order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n"))).toDF("n", "value")
    return parse_whitelist(lines.where("value <> ''"), top_n, min_count, sep)


def parse_vocabulary(lines: DataFrame) -> DataFrame:
    """Distinct words of lines (value): blank ones and comments don't count; what stands before a tab, or the first word."""
    value = F.trim("value")
    word = F.when(value.contains("\t"), F.trim(F.element_at(F.split(value, "\t"), 1))).otherwise(F.element_at(F.split(value, r"\s+"), 1))
    return lines.where((value != "") & ~value.startswith("#")).select(word.alias("word")).distinct().orderBy("word")


def model_year(name: Column) -> Column:
    """The year in a model's name: the number behind y in a part of it, else its last part."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(?:^|_)y(\d+)(?:_|\.|$)", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"(?:^|_)(\d+)(?:\.[a-z]+)?$", 1), F.lit(""))).cast("int")


def yearly_models(spark: SparkSession, models: DataFrame, first: int, last: int, step: int = 1) -> DataFrame:
    """year, found for each year from first to last: whether models (year) has it."""
    wanted = spark.range(first, last + 1, step).select(F.col("id").cast("int").alias("year"))
    return wanted.join(models.select("year").distinct().withColumn("found", F.lit(True)), "year", "left").select("year", F.coalesce("found", F.lit(False)).alias("found"))


def one_model(vectors: DataFrame, model_id: str) -> DataFrame:
    out = vectors.where(F.col("model_id") == model_id)
    if out.isEmpty():
        raise FileNotFoundError(f"no model {model_id!r}")
    return out


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by order for each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def corpus_paths(folder: str, genres: list[str] | None = None) -> dict[str, str]:
    """Names of a corpus's tables; those of a choice of genres carry it, sorted."""
    suffix = "_" + "+".join(sorted(genres)) if genres else ""
    root = Path(folder)
    return {k: str(root / f"{k}{suffix}") for k in ("raw", "filtered", "whitelist", "pivoted", "models")}
