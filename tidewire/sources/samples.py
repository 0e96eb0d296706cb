"""Metric samples: ``metric, labels, ts, value``.

A sample table on disk is partitioned by metric and UTC day, so a selector with
a metric name and a time range reads only its own folders.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.labels import SERIES, label, series_id
from tidewire.plans.tables import utc_day
from tidewire.sources import paths

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def write(samples: DataFrame, path: str) -> None:
    """Append samples; days and metrics are gathered into few, evenly sized files."""
    rows = samples.select(*SAMPLE_SCHEMA.names).withColumn("day", utc_day(F.col("ts")))
    rows = rows.hint("rebalance", F.col("metric"), F.col("day"))
    rows.write.mode("append").partitionBy("metric", "day").parquet(path)


def read(spark: SparkSession, path: str, metrics: Iterable[str] | None = None) -> DataFrame:
    """Samples of a table, with their ``day``; of some metrics without a look into other folders."""
    schema = T.StructType([*SAMPLE_SCHEMA.fields, T.StructField("day", T.DateType())])
    if metrics is None:
        return spark.read.schema(schema).parquet(path)
    folders = [f"{path}/metric={paths.escaped(m)}" for m in sorted(set(metrics))]
    there = [f for f in folders if paths.exists(spark, f)]
    if not there:
        return read(spark, path).where(F.lit(False))
    return spark.read.schema(schema).option("basePath", path).parquet(*there)


def chunked(samples: DataFrame, series: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The columns that name a ``series``, ``day``, and for each of the ``values`` the points (ts, value) of an hour.

    A series has at most one sample a millisecond, which bounds a chunk.
    """
    hour = F.floor(F.unix_micros("ts") / F.lit(3_600_000_000))
    rows = samples.select(*series, "ts", *values, utc_day(F.col("ts")).alias("day"), hour.alias("hour"))
    points = [F.collect_list(F.struct("ts", F.col(v).alias("value"))).alias(v) for v in values]
    return rows.groupBy("day", "hour", *series).agg(*points).drop("hour")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append ``metric, labels, points, day``, gathered like samples; labels are there once for many of these."""
    rows = chunks.select("labels", "points", "metric", "day").hint("rebalance", F.col("metric"), F.col("day"))
    rows.write.mode("append").partitionBy("metric", "day").parquet(path)


def read_chunks(spark: SparkSession, path: str, metrics: Iterable[str]) -> DataFrame:
    """``metric, labels, points, day`` of some metrics in a table of chunks, without a look into other folders."""
    folders = [f"{path}/metric={paths.escaped(m)}" for m in sorted(metrics)]
    schema = "labels map<string,string>, points array<struct<ts: timestamp, value: double>>, metric string, day date"
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def of_chunks(chunks: DataFrame) -> DataFrame:
    """The samples of chunks, with the columns that name a series.

    What depends on metric and labels alone is worked out, and filtered by, once for a chunk.
    """
    named = chunks.select("metric", "labels", "day", *series_id(), "points")
    rows = named.select("metric", "labels", "day", *SERIES, F.explode("points").alias("point"))
    return rows.select("metric", "labels", "point.ts", "point.value", "day", *SERIES)


def scan(
    samples: DataFrame,
    metric: str | None = None,
    after: datetime | None = None,
    until: datetime | None = None,
    targets: dict[str, Iterable[str]] | None = None,
) -> DataFrame:
    """Samples of one metric in ``(after, until]`` whose labels lie in the target lists."""
    rows = samples
    has_day = "day" in samples.columns
    if metric is not None:
        rows = rows.where(F.col("metric") == metric)
    if after is not None:
        bound = F.lit(after).cast("timestamp")
        rows = rows.where(F.col("ts") > bound)
        rows = rows.where(F.col("day") >= utc_day(bound)) if has_day else rows
    if until is not None:
        bound = F.lit(until).cast("timestamp")
        rows = rows.where(F.col("ts") <= bound)
        rows = rows.where(F.col("day") <= utc_day(bound)) if has_day else rows
    for name, allowed in (targets or {}).items():
        rows = rows.where(label(name).isin(*allowed))
    return rows
