"""Streaming extensions: files as they arrive, duplicates by content, windows with late data, per-user sessions.

The original has no streaming. Each function takes a streaming or a static DataFrame and gives one back, so that the same
logic is tested on static data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of a folder as a stream of (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", glob).load(path)


def stream_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def distinct_contents(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """Files with a content not seen within the watermark; state is kept for that time only."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    if files.isStreaming:
        return hashed.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])
    return hashed.dropDuplicates(["sha256"])


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", delay: str = "30 minutes") -> DataFrame:
    """(start, end, kind, n): events by tumbling window; later ones than the watermark are left out of a stream."""
    e = events.withWatermark(time, delay) if events.isStreaming else events
    return e.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", kind, "n")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user, start, end, n): sessions of events with gaps under ``gap``."""
    e = events.withWatermark(time, delay) if events.isStreaming else events
    s = e.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return s.select(user, "w.start", "w.end", "n")


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append", format: str = "parquet") -> None:
    """Process all that is there now, then stop; a later call goes on from the checkpoint."""
    df.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
