"""The shapes that the operators work on, made of the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    """year, ngram, occurrences, documents: part names and types by year of shipment."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("ngram"))
    line = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_quantity", F.year("l_shipdate").alias("year"))
    own = line.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return own.groupBy("year", "ngram").agg(F.sum("l_quantity").cast("long").alias("occurrences"), F.countDistinct("l_orderkey").alias("documents"))


def brand_counts(spark: SparkSession, d: str) -> DataFrame:
    """Names and brands, with part-of-speech tags on the names."""
    n = F.split("p_name", " ")
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.concat(F.initcap(F.element_at(n, 1)), F.lit("_ADJ")), F.concat(F.element_at(n, 2), F.lit("_NOUN")), "p_brand").alias("ngram"))
    line = table(spark, d, "lineitem").select("l_partkey", "l_quantity", F.year("l_shipdate").alias("year"))
    return line.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("year", "ngram").agg(F.sum("l_quantity").cast("long").alias("occurrences"), F.count("*").alias("documents"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text, year, genre (null where it is en)."""
    return table(spark, d, "documents").select("doc_id", "text", (1900 + F.col("doc_id") % 100).cast("int").alias("year"), F.nullif("lang", F.lit("en")).alias("genre"))


def models(spark: SparkSession, d: str) -> DataFrame:
    """year, word, vector, count, model_id: ten yearly models."""
    v = table(spark, d, "embeddings")
    year = (2000 + F.col("vec_id") % 10).cast("int")
    return v.select(F.concat(F.lit("w2v_y"), year).alias("model_id"), year.alias("year"), F.concat(F.lit("w"), F.floor(F.col("vec_id") / 10).cast("string")).alias("word"), F.col("embedding").cast("array<double>").alias("vector"), (1 + F.col("vec_id") * 7919 % 1000).alias("count"))
