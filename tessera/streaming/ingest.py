"""Continuous ingest and monitoring with Structured Streaming; batch twins share the code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.store import KeyedTable, latest


def read_table_stream(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = 64):
    """Upserts what arrives into a keyed table and returns the started query; a batch rewrites the buckets that its keys fall into, no others.

    A batch that is run again after a failure changes nothing: the table's version names the last batch that it holds.
    """

    def write(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, target, keys, buckets).upsert(latest(prepare(batch), keys, order), number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two listings (path, modified): added, modified (another time) or deleted."""
    both = before.select("path", F.col("modified").alias("a")).join(after.select("path", F.col("modified").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def debounced(changes: DataFrame, gap: str = "2 seconds", delay: str | None = None) -> DataFrame:
    """(path, start, change): a file's changes (path, ts, change) with less than `gap` between them as one; a deletion among them wins, else the last counts."""
    if delay:
        changes = changes.withWatermark("ts", delay)
    found = changes.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.bool_or(F.col("change") == "deleted").alias("gone"), F.max_by("change", F.struct("ts", "change")).alias("last"))
    return found.select("path", F.col("w.start").alias("start"), F.when(F.col("gone"), "deleted").otherwise(F.col("last")).alias("change"))


def unseen(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """First rows of each key; state is kept no longer than the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, size: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by tumbling or sliding windows; delay: the watermark, for streams."""
    if delay:
        events = events.withWatermark("ts", delay)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """(user_id, start, n, last_type): bursts of a user's events with less than `gap` between them, and the last action."""
    if delay:
        events = events.withWatermark("ts", delay)
    found = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    return found.select("user_id", F.col("w.start").alias("start"), "n", "last_type")
