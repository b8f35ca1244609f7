"""Windowed metrics and index refresh over streams; the same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, watermark: str | None) -> DataFrame:
    """Watermarks need a timestamp with a time zone: one without is read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if watermark else events


def windowed_metrics(events: DataFrame, width: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """events (ts, event_type, value) -> window_start, event_type, n, total. A stream needs a watermark: events later
    than that are left out, and windows are final when it has passed them."""
    timed = _timed(events, watermark)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Per user, runs of events less than gap apart: user_id, session_start, session_end, n."""
    timed = _timed(events, watermark)
    found = timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def refresh_postings(stream: DataFrame, path: str, checkpoint: str, key: str = "chunk_id"):
    """Appends the counts of every new batch of chunks, none of which changes later, to a Parquet table (upkeep.py keeps an
    index that can be searched, changes and deletions included); a batch that is repeated after a failure
    overwrites its own folder, so no posting appears twice."""
    from ..operators import bm25

    def write(batch: DataFrame, epoch: int) -> None:
        bm25.term_counts(batch, key).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
