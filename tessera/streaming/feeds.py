"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late else events


def unique_events(events: DataFrame, late: str | None = "1 hour") -> DataFrame:
    """Drops repeated event ids; state is forgotten after the watermark. late None: the stream has its watermark."""
    return _marked(events, late).dropDuplicatesWithinWatermark(["event_id"])


def session_batches(events: DataFrame, by: str, quiet: str, late: str | None = "1 hour") -> DataFrame:
    """Debounced batches: sessions that a gap of `quiet` closes."""
    return _marked(events, late).groupBy(by, F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n_events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def tumbling_counts(events: DataFrame, by: str, width: str, late: str | None = "1 hour") -> DataFrame:
    return _marked(events, late).groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("start"), by, "n_events")


def refresh_each(changes: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of changed paths (path, kind, event_id) is one generation: the strongest kind per path (rescan > rename > change), in order of path."""
    strength = F.expr("CASE kind WHEN 'rescan' THEN 2 WHEN 'rename' THEN 1 ELSE 0 END")

    def one(batch: DataFrame, generation: int) -> None:
        merged = batch.groupBy("path").agg(F.max_by("kind", strength).alias("kind")).orderBy("path")
        refresh(merged, generation)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
