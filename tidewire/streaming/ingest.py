"""The ingest job: one run-to-now stream per message type, on one session.

Each stream reads its own topic, decodes, routes every record, appends the good
ones to its own table and the rest, with a reason, to one shared dead-letter
table. Streams start together, share the executors and fail independently.
"""

from __future__ import annotations

import logging
from collections import Counter, defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidewire.functions.codec import JsonCodec
from tidewire.functions.headers import header_int, header_text
from tidewire.functions.routing import OK, REASONS, event_time, record_route
from tidewire.operators.dedup import OffsetLedger
from tidewire.plans import tables
from tidewire.registry import SCHEMA_HEADER, VERSION_HEADER, StreamSpec, validate
from tidewire.sources import paths

log = logging.getLogger("tidewire.ingest")


@dataclass(frozen=True)
class IngestSettings:
    """What all streams of a job share.

    ``failed_at`` stamps rejects, with the processing time unless a column is
    given. ``idempotent`` makes a replayed micro-batch overwrite what its first
    run wrote; rejects are then stamped with the record's own time, which does
    not change between runs.

    ``ledger`` is a folder where each stream keeps which offsets it has delivered, so
    that records delivered again are left out; it needs ``idempotent``. ``progress`` is a
    folder where each micro-batch leaves its counts, so that totals include runs before.
    """

    rejects: str
    codec: object = JsonCodec()
    failed_at: Callable[[], Column] | None = None
    idempotent: bool = False
    rebalance: bool = False
    known: tuple[str, ...] = ()
    ledger: str | None = None
    progress: str | None = None

    def __post_init__(self) -> None:
        if self.ledger and not self.idempotent:
            raise ValueError("a ledger needs idempotent writes: a micro-batch that runs again delivers the same records")

    def stamp(self) -> Column:
        if self.failed_at is not None:
            return self.failed_at()
        return F.col("timestamp") if self.idempotent else F.current_timestamp()


_PROGRESS = "route string, cnt long"


@dataclass
class Totals:
    """Rows per stream and route, summed over micro-batches."""

    batches: dict[str, dict[int, Counter]] = field(default_factory=lambda: defaultdict(dict))

    def add(self, query: str, batch_id: int, counts: Counter) -> None:
        # A batch that runs again replaces its first count.
        self.batches[query][batch_id] = counts

    @classmethod
    def stored(cls, spark: SparkSession, progress: str, queries: Sequence[str]) -> Totals:
        """The sums of all micro-batches that left their counts in ``progress``, by these streams."""
        out = cls()
        for query in queries:
            if paths.exists(spark, _progress(progress, query)):
                rows = spark.read.schema(f"{_PROGRESS}, batch_id long").parquet(_progress(progress, query))
                # One row per route, however many micro-batches there were.
                summed = rows.groupBy("route").agg(F.sum("cnt").alias("cnt")).collect()
                out.add(query, -1, Counter({r["route"]: r["cnt"] for r in summed}))
        return out

    def routes(self, query: str) -> Counter:
        return sum(self.batches.get(query, {}).values(), Counter())

    def rows(self, query: str) -> int:
        return sum(self.routes(query).values())


class IngestFailed(RuntimeError):
    """Raised after all streams have ended, when at least one failed."""

    def __init__(self, failures: dict[str, str], totals: Totals):
        self.failures, self.totals = failures, totals
        super().__init__("; ".join(f"{name}: {text}" for name, text in sorted(failures.items())))


def parse(records: DataFrame, spec: StreamSpec, codec=JsonCodec()) -> DataFrame:
    """Headers and payload of each record, next to its raw bytes and coordinates."""
    read = records.select(
        F.col("value").alias("rawdata"),
        F.col("value").alias("payload"),
        header_text("headers", SCHEMA_HEADER).alias("proto_schema"),
        header_int("headers", VERSION_HEADER).alias("proto_version"),
        *tables.COORDINATES,
        "timestamp",
    )
    return codec.decode(read, "payload", spec).withColumn("event_time", event_time())


def route(parsed: DataFrame, spec: StreamSpec) -> DataFrame:
    return parsed.withColumn("route", record_route(spec.schema_name, spec.max_version))


def valid_rows(routed: DataFrame) -> DataFrame:
    """Good records in the columns of the event table, and their coordinates."""
    return routed.where(F.col("route") == OK).select(
        F.col("payload.id").alias("id"),
        F.col("event_time").alias("datetime"),
        F.col("proto_schema").alias("schema_name"),
        "rawdata",
        *tables.COORDINATES,
    )


def reject_rows(routed: DataFrame, failed_at: Column) -> DataFrame:
    """All other records in the columns of the dead-letter table, and their coordinates."""
    return routed.where(F.col("route") != OK).select(
        failed_at.alias("failed_at"),
        F.col("proto_schema").alias("schema_name"),
        "rawdata",
        F.col("route").alias("reason"),
        *tables.COORDINATES,
    )


def _progress(folder: str, query: str) -> str:
    return f"{folder}/query={query}"


def _keep_counts(spark: SparkSession, folder: str, query: str, batch_id: int, counts: Counter) -> None:
    """One small file for each micro-batch; one that runs again replaces its own."""
    rows = spark.createDataFrame(list(counts.items()), _PROGRESS).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{_progress(folder, query)}/batch_id={batch_id}")


def batch_writer(spec: StreamSpec, settings: IngestSettings, totals: Totals, query_id: str | None = None):
    """The function that writes one micro-batch of parsed records of ``spec``.

    Nothing is cached and nothing is counted on its own. The write of the good rows
    passes all rows by and observes whether there are rejects; only then do these get a
    write. Both writes count the rows that come out of them, behind their last shuffle, so
    that a task run again after an executor was lost counts once.
    """
    known = settings.known or (spec.schema_name,)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if settings.ledger:
            batch = OffsetLedger(f"{settings.ledger}/{spec.query_name}").take(batch, batch_id)
        routed = route(batch, spec)
        key = None
        if settings.idempotent:
            key = (query_id or spark.sparkContext.getLocalProperty("sql.streaming.queryId"), batch_id)
        seen = Observation()
        passing = routed.observe(seen, F.coalesce(F.max(F.col("route") != OK), F.lit(False)).alias("rejects"))
        merges = key is not None and not tables.is_folder(spec.target)
        good = valid_rows(routed if merges else passing)
        counts = Counter(
            tables.append(good, spec.target, tables.EVENTS, (), key, settings.rebalance, {OK: F.count(F.lit(1))})
        )
        # Where no good row came through, the plan that would have seen the others may be gone.
        # A filter does not go below what is observed, so a record is decoded and routed once, not once more to be left out.
        rejects = reject_rows(routed.observe(Observation(), F.count(F.lit(1)).alias("seen")), settings.stamp())
        if rejects.take(1) if merges or not counts[OK] else seen.get["rejects"]:
            reasons = {r: F.count_if(F.col("reason") == r) for r in REASONS}
            rejected = tables.append(rejects, settings.rejects, tables.REJECTS, known, key, settings.rebalance, reasons)
            counts.update(rejected)
            log.warning(
                "%s batch %s: %s of %s records rejected", spec.query_name, batch_id, sum(rejected.values()), sum(counts.values())
            )
        counts = Counter({name: n for name, n in counts.items() if n})
        if settings.progress:
            _keep_counts(spark, settings.progress, spec.query_name, batch_id, counts)
        totals.add(spec.query_name, batch_id, counts)

    return write


def ingest_batch(
    records: DataFrame, spec: StreamSpec, settings: IngestSettings, run_id: str | None = None
) -> Totals:
    """Route and write a bounded set of records without a stream.

    In idempotent mode ``run_id`` names the set: running it again replaces what
    it wrote before, so different sets need different names.
    """
    if settings.idempotent and not run_id:
        raise ValueError("idempotent mode needs a run_id")
    totals = Totals()
    spark = records.sparkSession
    tables.open_table(spark, spec.target)
    tables.open_table(spark, settings.rejects)
    batch_writer(spec, settings, totals, query_id=run_id)(parse(records, spec, settings.codec), 0)
    return totals


def start(spark: SparkSession, spec: StreamSpec, source, settings: IngestSettings, totals: Totals) -> StreamingQuery:
    """Start one stream; returns at once."""
    tables.open_table(spark, spec.target)
    tables.open_table(spark, settings.rejects)
    parsed = parse(source.stream(spark, spec), spec, settings.codec)
    return (
        parsed.writeStream.queryName(spec.query_name)
        .option("checkpointLocation", spec.checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .foreachBatch(batch_writer(spec, settings, totals))
        .start()
    )


def run(
    spark: SparkSession, specs: Sequence[StreamSpec], source, settings: IngestSettings, at_once: int | None = None
) -> Totals:
    """Start all streams, wait for all of them, then report or raise.

    At most ``at_once`` streams run at a time, all unless given. Whatever a stream fails
    with, at its start or later, the others are started and awaited.
    """
    specs = validate(specs)
    if not settings.known:
        settings = replace(settings, known=tuple(s.schema_name for s in specs))
    totals, failures, running = Totals(), {}, []
    context = spark.sparkContext

    def failed(spec: StreamSpec, error: Exception) -> None:
        failures[spec.query_name] = (str(error).splitlines() or [type(error).__name__])[0]
        log.error("%s failed: %s", spec.query_name, failures[spec.query_name])

    def finish(spec: StreamSpec, query: StreamingQuery) -> None:
        try:
            query.awaitTermination()
            log.info("%s finished: %s rows", spec.query_name, totals.rows(spec.query_name))
        except Exception as error:
            failed(spec, error)

    for spec in specs:
        if at_once and len(running) >= at_once:
            # The first one that has ended makes room, else the longest running one.
            ended = next((n for n, (_, query) in enumerate(running) if not query.isActive), 0)
            finish(*running.pop(ended))
        # With the FAIR scheduler each stream gets its share of the executors.
        context.setLocalProperty("spark.scheduler.pool", spec.query_name)
        try:
            running.append((spec, start(spark, spec, source, settings, totals)))
        except Exception as error:
            failed(spec, error)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)
    for spec, query in running:
        finish(spec, query)
    if failures:
        raise IngestFailed(failures, totals)
    return totals
