"""Incremental index sync over a stream of chunk files, and windowed counts of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versions import VersionedTable


def sync_stream(spark: SparkSession, chunks: DataFrame, path: str, checkpoint: str, key: str = "point_id", source: str = "source_path", buckets: int = 32) -> StreamingQuery:
    """Applies each micro-batch to a versioned index under `path`: the rows of a batch are all that their sources now have.

    Only buckets of a batch's sources are written. A batch that is replayed, after a restart between its publication and
    the stream's own commit, changes nothing.
    """
    table = VersionedTable(spark, path, key, source, buckets)

    def apply(batch: DataFrame, epoch: int) -> None:
        table.apply(batch, epoch)

    return chunks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of values by type and window, closed once the watermark passes; an addition of this library."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
