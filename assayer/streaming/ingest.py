"""Structured Streaming form of ingestion: deduplicated texts with their scans, and windowed tool metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import text as tx


def scan_stream(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stateless scans; works on batch and streaming input alike."""
    t = F.col(text)
    return documents.select(key, F.sha2(t, 256).alias("text_hash"), tx.context_id(t).alias("context_id"), tx.signal(t).alias("signal"))


def windowed_tools(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Calls and mean value per tool and window; late rows beyond the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("calls"), F.avg("value").alias("mean_value"))
