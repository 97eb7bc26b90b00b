"""Schemas of the tables that the library reads and writes; nothing is inferred."""

from pyspark.sql import types as T

COUNT = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("occurrences", T.LongType()), T.StructField("documents", T.LongType())])
#: One row an n-gram, with its yearly counts.
WIDE = T.StructType([T.StructField("ngram", T.StringType()), T.StructField("freqs", T.ArrayType(COUNT))])
#: One row an n-gram and year; stored in partitions by year.
LONG = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("ngram", T.StringType()), T.StructField("occurrences", T.LongType()), T.StructField("documents", T.LongType())])
METADATA = T.StructType(
    [T.StructField("text_id", T.LongType()), T.StructField("year", T.IntegerType()), T.StructField("genre", T.StringType()), T.StructField("title", T.StringType()), T.StructField("author", T.StringType()), T.StructField("words", T.LongType())]
)
VECTORS = T.StructType(
    [T.StructField("model_id", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("count", T.LongType())]
)
