"""Structured Streaming forms of the stream operators. Batch and streaming share the column logic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_stream(spark, path: str, static: DataFrame) -> DataFrame:
    """A file stream with the schema of a table, timed in UTC; ``path`` is a folder, or a table's one file."""
    reader = spark.readStream.schema(static.schema)
    folder, name = path.rstrip("/").rsplit("/", 1)
    if static.inputFiles()[0].endswith(f"/{name}"):
        reader, path = reader.option("pathGlobFilter", name), folder
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def bucket_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by type and tumbling bucket, known when the bucket ends; rows later than the watermark are dropped in a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    g = timed.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.unix_seconds(F.col("w.start")).alias("start"), F.unix_seconds(F.col("w.end")).alias("known"), "n", F.round("total", 4).alias("total"))


def look_back(counts: DataFrame, hours: int) -> DataFrame:
    """Each bucket with the mean of the ``hours`` buckets before it that are already known."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("start").rangeBetween(-3600 * hours, -3600)
    return counts.withColumn("before", F.round(F.avg("n").over(w), 6))


def available(rows: DataFrame, facts: DataFrame, by: str, at: str, known: str, value: str) -> DataFrame:
    """Each row with the latest fact that was known by then."""
    from ..operators.joins import asof

    return asof(rows, facts, by, at, known, value, strict=False)


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Run over all that is available, append mode, into files of a shared folder, and read those."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run over all that is available, into a table in memory."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.table(name)
