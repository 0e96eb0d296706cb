"""Removal of records that were delivered more than once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.sources import paths
from tidewire.sources.records import RECORD_SCHEMA

EVENT_KEY = ("schema_name", "id")
RECORD_KEY = ("topic", "partition", "offset")


def first_copies(df: DataFrame, key: Sequence[str] = EVENT_KEY, order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the smallest in ``order``, by default all other columns.

    An aggregate, not a row number: every task first reduces its own copies, so
    a key with very many copies never gathers in one place.
    """
    others = [c for c in df.columns if c not in key]
    ranked = list(order or others)
    body = F.struct(*ranked, *[c for c in others if c not in ranked])
    return df.groupBy(*key).agg(F.min(body).alias("row")).select(
        *[F.col(c) if c in key else F.col("row")[c].alias(c) for c in df.columns]
    )


def _with_coordinates(df: DataFrame) -> DataFrame:
    if not set(RECORD_KEY) <= set(df.columns):
        raise ValueError(f"the records need {RECORD_KEY} as in {RECORD_SCHEMA.names}")
    return df


def first_deliveries(stream: DataFrame, lateness: str = "1 hour", salts: int = 1) -> DataFrame:
    """Records of a stream without repeats of the same coordinates.

    A record's coordinates are kept for ``lateness`` from when it arrives, whatever
    its own time, so a first delivery is never late and never dropped; a repeat that
    comes after that passes, as does not with an ``OffsetLedger``. All copies of a record
    meet in one task; where single records may come very often, ``salts`` first drops
    copies in that many groups by input partition, at the price of a second state.
    """
    rows = _with_coordinates(stream).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", lateness)
    if salts > 1:
        salted = rows.withColumn("salt", F.spark_partition_id() % salts)
        rows = salted.dropDuplicatesWithinWatermark([*RECORD_KEY, "salt"]).drop("salt")
    return rows.dropDuplicatesWithinWatermark(list(RECORD_KEY)).drop("_arrived")


SOURCE = ("topic", "partition")
INTERVALS = "topic string, partition int, low long, high long"

#: Offsets that are looked up together: a block has at most half as many intervals.
BLOCK = 1024


def offset_runs(offsets: DataFrame) -> DataFrame:
    """Runs (topic, partition, low, high) of distinct offsets without a gap, within blocks."""
    block = F.expr(f"offset div {BLOCK}")
    number = F.row_number().over(Window.partitionBy(*SOURCE, "block").orderBy("offset"))
    return (
        offsets.select(*SOURCE, "offset")
        .distinct()
        .withColumn("block", block)
        .withColumn("run", F.col("offset") - number)
        .groupBy(*SOURCE, "block", "run")
        .agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
        .select(*SOURCE, "low", "high")
    )


def merged(intervals: DataFrame) -> DataFrame:
    """Disjoint intervals with those that touch made one.

    A bound is dropped where another interval goes on from it, which is found by equal
    values; what is left are the bounds of gaps, and the lows and highs of a partition
    pair up in their order.
    """
    lows, highs = intervals.select(*SOURCE, F.col("low").alias("at")), intervals.select(*SOURCE, F.col("high").alias("at"))
    begins = lows.join(highs.withColumn("at", F.col("at") + 1), [*SOURCE, "at"], "left_anti")
    ends = highs.join(lows.withColumn("at", F.col("at") - 1), [*SOURCE, "at"], "left_anti")
    both = begins.withColumn("ends", F.lit(False)).unionAll(ends.withColumn("ends", F.lit(True)))
    # Before the low of an interval of one offset comes nothing, so the low goes first.
    order = Window.partitionBy(*SOURCE).orderBy("at", "ends")
    paired = both.withColumn("high", F.lead("at").over(order))
    return paired.where(~F.col("ends")).select(*SOURCE, F.col("at").alias("low"), "high")


def not_in(offsets: DataFrame, intervals: DataFrame) -> DataFrame:
    """Distinct (topic, partition, offset) that no interval has.

    No range join: a block of offsets needs the intervals that begin in it, found by
    equal blocks, and the last one before it, found in one ordered pass over blocks and
    intervals. A hot partition adds one row for every block to that pass.
    """
    asked = offsets.select(*SOURCE, "offset").distinct().withColumn("block", F.expr(f"offset div {BLOCK}"))
    blocks = asked.select(*SOURCE, "block").distinct()
    held = intervals.select(*SOURCE, F.expr(f"low div {BLOCK}").alias("block"), F.struct("low", "high").alias("interval"))
    inside = held.join(blocks, [*SOURCE, "block"], "left_semi")
    # An interval comes behind the block it begins in, so a block sees those before it.
    order = Window.partitionBy(*SOURCE).orderBy("block", F.col("interval").isNotNull(), "interval.low")
    nothing = F.lit(None).cast("struct<low:bigint,high:bigint>").alias("interval")
    line = held.unionAll(blocks.select(*SOURCE, "block", nothing))
    earlier = line.withColumn("before", F.last("interval", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    earlier = earlier.where(F.col("interval").isNull() & (F.col("before.high") >= F.col("block") * BLOCK))
    known = inside.unionAll(earlier.select(*SOURCE, "block", F.col("before").alias("interval")))
    known = known.groupBy(*SOURCE, "block").agg(F.collect_list("interval").alias("intervals"))
    covers = F.exists("intervals", lambda i: (i["low"] <= F.col("offset")) & (F.col("offset") <= i["high"]))
    return (
        asked.join(known, [*SOURCE, "block"], "left")
        .where(~F.coalesce(covers, F.lit(False)))
        .select(*SOURCE, "offset")
    )


@dataclass(frozen=True)
class OffsetLedger:
    """Which offsets of each topic partition were delivered, as intervals without gaps.

    The intervals lie below ``folder``, one table for each micro-batch. So a repeat is
    known however late it comes, and the ledger grows with the gaps between delivered
    offsets, not with their number or with time. A micro-batch is held against the
    last finished table of an earlier one: run again, it delivers the same records again,
    which suits sinks that replace what a micro-batch wrote before.
    """

    folder: str

    def _runs(self, spark: SparkSession) -> list[int]:
        names = [n.removeprefix("batch=") for n in paths.children(spark, self.folder) if n.startswith("batch=")]
        return sorted(int(n) for n in names if paths.exists(spark, f"{self.folder}/batch={n}/_SUCCESS"))

    def delivered(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Intervals delivered by all micro-batches, or by those before a given one."""
        runs = [n for n in self._runs(spark) if before is None or n < before]
        if not runs:
            return spark.createDataFrame([], INTERVALS)
        return spark.read.schema(INTERVALS).parquet(f"{self.folder}/batch={runs[-1]}")

    def take(self, records: DataFrame, batch_id: int) -> DataFrame:
        """The first deliveries among a micro-batch's records, and their offsets added to the ledger.

        Records without a topic, partition or offset are let through. Only coordinates are
        compared; the records themselves are shuffled once, after each task dropped its own
        copies. Tables older than those of the last two micro-batches are removed.
        """
        spark = _with_coordinates(records).sparkSession
        named = F.col("topic").isNotNull() & F.col("partition").isNotNull() & F.col("offset").isNotNull()
        before = self.delivered(spark, batch_id)
        now = f"{self.folder}/batch={batch_id}"
        fresh = f"{self.folder}/fresh={batch_id}"
        not_in(records.where(named), before).write.mode("overwrite").parquet(fresh)
        new = spark.read.schema("topic string, partition int, offset long").parquet(fresh)
        merged(before.unionAll(offset_runs(new))).write.mode("overwrite").parquet(now)
        for old in [n for n in self._runs(spark) if n < batch_id][:-1]:
            paths.drop_dir(spark, f"{self.folder}/batch={old}")
            paths.drop_dir(spark, f"{self.folder}/fresh={old}")
        once = records.where(named).dropDuplicates(list(RECORD_KEY)).join(new, list(RECORD_KEY), "left_semi")
        return once.unionByName(records.where(~named))
