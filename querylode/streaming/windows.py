"""Pattern costs over time, from a stream of slow-log events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylode.functions.text import fingerprint


def windowed_costs(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, fingerprint, occurrences, total_query_time, max_rows_examined. On a stream, events later than `late` behind the newest are left out; a batch counts all."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    spans = F.window("ts", window, slide) if slide else F.window("ts", window)
    found = timed.groupBy(spans.alias("w"), fingerprint("sql").alias("fingerprint")).agg(F.count("*").alias("occurrences"), F.sum("query_time").alias("total_query_time"), F.max("rows_examined").alias("max_rows_examined"))
    return found.select(F.col("w.start").alias("window_start"), "fingerprint", "occurrences", "total_query_time", "max_rows_examined")


def bursts(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of one pattern without a gap: started, ended, fingerprint, occurrences."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    found = timed.groupBy(F.session_window("ts", gap).alias("w"), fingerprint("sql").alias("fingerprint")).agg(F.count("*").alias("occurrences"))
    return found.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "fingerprint", "occurrences")
