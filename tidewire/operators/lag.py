"""How far consumer groups are behind the end of their topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_offsets(records: DataFrame, *by: str) -> DataFrame:
    """Offset after the last one, per topic and partition and any further columns."""
    return records.groupBy(*by, "topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def consumer_lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """Lag per group, topic and partition.

    ``ends`` has one row per topic and partition, ``committed`` one per group,
    topic and partition. A partition no group has read keeps NULLs. Both sides
    are aggregates of at most one row per group and partition.
    """
    joined = ends.withColumnRenamed("next_offset", "log_end").join(
        committed.withColumnRenamed("next_offset", "committed"), ["topic", "partition"], "left"
    )
    return joined.select(
        "consumergroup", "topic", "partition", "log_end", "committed", (F.col("log_end") - F.col("committed")).alias("lag")
    )
