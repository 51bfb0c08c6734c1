"""Streams of events: windowed activity, sessions, late rows, changed days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) with a watermark; works on a stream and, with the same rows, on a table."""
    marked = events.withWatermark("ts", late)
    counts = marked.groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no pause longer than gap."""
    marked = events.withWatermark("ts", late)
    runs = marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return runs.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def changed_days(events: DataFrame, quiet: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """(day, start, end, edits): bursts of edits of a day; a burst ends once nothing came for `quiet`."""
    marked = events.withWatermark("ts", late).withColumn("day", F.to_date("ts"))
    return marked.groupBy(F.session_window("ts", quiet), "day").agg(F.count("*").alias("edits")).select("day", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "edits")


def start_with_late_log(events: DataFrame, is_late: Callable[[DataFrame], DataFrame], on_time: Callable[[DataFrame, int], None], late_path: str, checkpoint: str):
    """Starts a query that hands each batch's timely rows to on_time and appends the others to late_path.

    Both are told the batch number: a batch that is repeated after a failure overwrites its own late rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        marked = is_late(batch)
        marked.where("late").drop("late").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        on_time(marked.where("NOT late").drop("late"), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
