"""Incremental ingest: new files of n-gram lines are read once, and their counts added to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipelines import ingest_ngrams


def ngram_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder)


def start(spark: SparkSession, folder: str, target: str, checkpoint: str, kind: str = "all", pairs: tuple[str, ...] = (), files_per_batch: int | None = None) -> StreamingQuery:
    """Reads all files of folder that earlier runs with this checkpoint haven't, then stops.

    Each batch's sums are written to a folder of their own, overwritten if the batch is run again: a file's
    counts get in once whatever fails. totals() adds the batches up.
    """

    def write(batch: DataFrame, number: int) -> None:
        ingest_ngrams(batch, kind, pairs).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return ngram_stream(spark, folder, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("year", "ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window of event time: the streaming form of year bins. Works on streams and tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
