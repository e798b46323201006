"""Streaming conversion: new files are converted as they come, what is done is not done again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docstrata.sources.files import convert, format_of


def stream(spark: SparkSession, path: str) -> DataFrame:
    """DOCUMENTS rows of the files that arrive under a path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(path)
    return convert(files.select("path", format_of(F.col("path")).alias("fmt"), "content"))


def run_available(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Convert what is there and stop; the file sink commits each batch once."""
    query = stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("fmt").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Running counts and sums of events by window and type, with a bound on lateness."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def job_status(documents: DataFrame) -> DataFrame:
    """Totals of a conversion job and its status."""
    counts = documents.agg(F.count("*").alias("total"), F.count("error").alias("failed"))
    return counts.withColumn("status", F.when(F.col("failed") == 0, "done").when(F.col("failed") == F.col("total"), "failed").otherwise("partial"))
