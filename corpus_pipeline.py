"""The corpus pipeline: each stage works on all that its predecessor kept, and its result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from yearloom.llm.decontaminate import decontaminate
from yearloom.llm.minhash import representatives
from yearloom.llm.packing import pack
from yearloom.llm.quality import accepted
from yearloom.llm.secrets import redacted
from yearloom.llm.storage import write_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, _table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Of rows that repeat an id one stays. Rows without an id stay unless they are in the group of one that stays; documents without words stay.
    """
    return representatives(docs, "lang", "source", "n_chars").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items: those over the limit go, shorter matches are cut out."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return redacted(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    import public_tokenizers as files

    return pack(docs, files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: A classifier, verification on hashed sets and a tokenizer can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
