"""Incremental de-replication and counting of a stream of records.

Null sequences are one group; null times are never counted; repeated records count again; a stream
without records gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dereplicate_stream(rows: DataFrame, seq: str, key: str) -> DataFrame:
    """Running counts per distinct sequence; to be written in update or complete mode."""
    return rows.groupBy(seq).agg(F.min(key).alias(key), F.count("*").alias("seq_count"))


def windowed_counts(rows: DataFrame, time: str, label: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Records per label and time window, for append mode; records later than ``late`` are dropped
    by the watermark."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), label).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), label, "n")
