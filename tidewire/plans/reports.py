"""Reports over the event tables and the dead-letter table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.codec import JsonCodec
from tidewire.functions.routing import event_time, replay_route
from tidewire.plans import tables
from tidewire.registry import StreamSpec


def _since(as_of: datetime | Column | None, back: str) -> Column:
    return tables.moment(as_of) - F.expr(f"interval {back}")


def recent_rejects(rejects: DataFrame, as_of=None, back: str = "1 day", limit: int = 100) -> DataFrame:
    """The newest rejects and the size of their raw bytes."""
    rows = tables.after(rejects, tables.REJECTS, _since(as_of, back)).select(
        "failed_at", F.octet_length("rawdata").alias("bytes"), "schema_name", "reason"
    )
    # The columns after the time settle which rows of one instant come first.
    order = [F.col("failed_at").desc(), "schema_name", "reason", F.col("bytes")]
    return rows.orderBy(*order).limit(limit)


def counts_by_type(spark: SparkSession, specs: Sequence[StreamSpec], as_of=None, back: str = "1 day") -> DataFrame:
    """Rows per message type since a moment; types without rows count zero."""
    rows = tables.after(tables.read(spark, tables.EVENTS, *[s.target for s in specs]), tables.EVENTS, _since(as_of, back))
    counted = rows.groupBy("schema_name").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(s.schema_name,) for s in specs], "schema_name string")
    return names.join(counted, "schema_name", "left").select("schema_name", F.coalesce("n", F.lit(0)).alias("cnt"))


def rejects_by_reason(rejects: DataFrame, at_least: int = 1) -> DataFrame:
    """Rejects per schema name, reason and day, where there are ``at_least`` so many."""
    day = F.col(tables.REJECTS.day)
    counted = rejects.groupBy("schema_name", "reason", day).agg(F.count("*").alias("cnt"))
    return counted.where(F.col("cnt") >= at_least)


def all_events(spark: SparkSession, specs: Sequence[StreamSpec], view: str | None = None) -> DataFrame:
    """Every event table as one, optionally registered as a view."""
    rows = tables.read(spark, tables.EVENTS, *[s.target for s in specs])
    if view:
        rows.createOrReplaceTempView(view)
    return rows


def replay(
    rejects: DataFrame,
    spec: StreamSpec,
    codec=JsonCodec(),
    reasons: Sequence[str] | None = None,
    accepted: Sequence[str] = (),
) -> DataFrame:
    """Decode stored rejects again.

    ``reason`` becomes what is wrong with a row now, ``ok`` when nothing is, and
    ``was`` keeps the stored reason. A missing or unsupported version stays a fault
    unless ``accepted`` names it.
    """
    rows = rejects.where(F.col("reason").isin(*reasons)) if reasons else rejects
    rows = rows.withColumnRenamed("reason", "was").withColumn("payload", F.col("rawdata"))
    decoded = codec.decode(rows, "payload", spec).withColumn("event_time", event_time())
    return decoded.withColumn("reason", replay_route(spec.schema_name, accepted))


def replayed_events(replayed: DataFrame) -> DataFrame:
    """Rows of a replay that are good now, in the columns of the event table."""
    return replayed.where(F.col("reason") == "ok").select(
        F.col("payload.id").alias("id"), F.col("event_time").alias("datetime"), "schema_name", "rawdata"
    )
