"""A landing folder as a stream: every new file is imported once, in micro-batches that can be repeated.

The checkpoint replaces a job table: after a lost driver the stream goes on where it was, and a batch that ran half is
run again over its own partitions of the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources.ingest import land


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Starts the import of all files of a folder that are there and, unless stopped, of those that come."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path", "length", "content", F.sha2("content", 256).alias("file_hash"))
    )
    return files.writeStream.foreachBatch(lambda df, epoch: land(df.sparkSession, df, store, f"b{epoch:08d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events per type and window with a watermark; the same plan for a stream and for a table."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
