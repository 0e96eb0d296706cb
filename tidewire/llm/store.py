"""Written tables below the folder that all executors share."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tidewire.session import work_dir
from tidewire.sources import paths

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that Spark hands to a Python worker.
BATCH_BYTES = 8 << 20


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    The plan behind it is cut there: a lost executor costs the tasks at hand,
    never a recomputation of what is already in the table. So the shuffles that led
    to it are of no more use, and their files go when it is written.
    """
    spark: SparkSession = df.sparkSession
    path = work_dir(spark, purpose)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again."""
    for table in tables:
        paths.drop_dir(table.sparkSession, table.stored_at)


def only(docs: DataFrame, ids: DataFrame, key: str = "doc_id", limit: int = 400_000) -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids`` (one row per key).

    The keys are counted first. Up to ``limit`` of them are broadcast, so the
    texts are filtered where they are read; beyond it both sides are shuffled.
    """
    from pyspark.sql import functions as F

    few = len(ids.select(key).limit(limit + 1).groupBy().count().where(F.col("count") <= limit).take(1)) == 1
    return docs.join(F.broadcast(ids) if few else ids, key, "left_semi")


def reachable(spark: SparkSession) -> SparkSession:
    """``spark``, whose Python workers look for this library where the driver found it.

    Batches of texts that go to them are bounded by bytes, for a batch of long texts could
    else take many times the memory of one of short ones.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
    if not 0 < int(spark.conf.get(_BATCH_BYTES).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return spark
