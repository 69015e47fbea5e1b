"""Sessions of an event stream, and incremental runs over what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def session_windows(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """session_id, start, end, n of stretches of events (session_id, ts) without a longer gap; batch or stream.

    On a stream a stretch is given out once the watermark has passed its end.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_new(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand everything that is new since the last run to ``handle``, batch by batch, then stop."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
