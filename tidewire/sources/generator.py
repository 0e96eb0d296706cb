"""Sample producers: indexes in, records out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.codec import JsonCodec
from tidewire.functions.headers import build_headers
from tidewire.registry import EVENT_PRODUCER, ProducerSpec, StreamSpec

# Defaults of the sample producer.
DEFAULT_COUNT = 10
DEFAULT_INTERVAL_SECONDS = 1.0


def bounded(spark: SparkSession, total: int = DEFAULT_COUNT) -> DataFrame:
    """Indexes 1 to ``total``."""
    return spark.range(1, total + 1).select(F.col("id").alias("index"))


def unbounded(spark: SparkSession, interval: float = DEFAULT_INTERVAL_SECONDS) -> DataFrame:
    """A stream of indexes from 1, one per micro-batch.

    Start the query with ``trigger(processingTime=f"{interval} seconds")``.
    """
    rows = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", 1)
        .option("advanceMillisPerBatch", max(1, round(interval * 1000)))
        .load()
    )
    return rows.select((F.col("value") + 1).alias("index"))


def records(
    indexes: DataFrame,
    stamp: Column | None = None,
    producers: Sequence[ProducerSpec] = (EVENT_PRODUCER,),
    codec=JsonCodec(),
    index: str = "index",
) -> DataFrame:
    """One record per index and producer: key, value, headers and topic."""
    now = F.current_timestamp() if stamp is None else stamp

    def one(producer: ProducerSpec) -> DataFrame:
        spec = StreamSpec(producer.schema_name, producer.topic, "-", "-", producer.version, producer.message)
        return indexes.select(
            F.col(index).cast("string").cast("binary").alias("key"),
            codec.encode(producer.payload(F.col(index), now), spec).alias("value"),
            build_headers(proto_schema=producer.schema_name, proto_version=str(producer.version)).alias("headers"),
            F.lit(producer.topic).alias("topic"),
        )

    return reduce(DataFrame.unionByName, [one(p) for p in producers])
