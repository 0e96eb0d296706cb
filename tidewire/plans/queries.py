"""The registered queries. Each takes a session and a folder of test tables.

Tables and record folders are written below the session's shared folder and
read back, so a query takes the way a job would take.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import codec
from tidewire.functions.headers import header_text
from tidewire.functions.labels import Matcher, label, label_text, legend, matches
from tidewire.operators import aggregates, dedup, lag, logs, naming, ranges, relabel, rewrite
from tidewire.plans import panels, reports, tables
from tidewire.registry import (
    DLQ_TABLE,
    EVENT_TOPIC,
    NOTIFICATION_TOPIC,
    SCHEMA_HEADER,
    VERSION_HEADER,
    StreamSpec,
    sample_registry,
)
from tidewire.session import shared_root, work_dir
from tidewire.sources import fixtures, generator, paths, records, samples
from tidewire.sources import logs as log_source
from tidewire.streaming import ingest
from tidewire.streaming import logs as log_job
from tidewire.streaming import metrics as metric_job
from tidewire.streaming.once import write_once

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

AS_OF = datetime(2024, 1, 30)
CHOSEN = {"kubernetes_namespace": "kafka", "strimzi_cluster_name": "my-cluster"}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def rounded(df: DataFrame) -> DataFrame:
    """Sums are exact; quotients are given with six places."""
    return df.withColumn("value", F.round("value", 6))


def record_time() -> Column:
    return F.col("timestamp")


class Job:
    """Folders, registry and settings of one ingest job."""

    def __init__(self, spark: SparkSession, topics=(EVENT_TOPIC,), purpose: str = "job", root: str | None = None, **settings):
        self.spark = spark
        self.root = root or work_dir(spark, purpose)
        self.specs = sample_registry(f"{self.root}/tables", f"{self.root}/checkpoints", topics)
        self.rejects_at = f"{self.root}/tables/{DLQ_TABLE}"
        # The test records span a month, so each write is a backfill of many days.
        given = {"failed_at": record_time, "rebalance": True, **settings}
        self.settings = ingest.IngestSettings(rejects=self.rejects_at, **given)
        self.source = records.FolderRecords(f"{self.root}/records")

    def send(self, rows: DataFrame) -> None:
        records.write_folder(rows, self.source.root)

    def send_in(self, rows: DataFrame, batches: int) -> records.FolderRecords:
        """Send records as many files, and a source whose micro-batches take an equal share of them.

        A micro-batch has a file for each core, however many records there are: one file
        may be read by one task alone.
        """
        each = self.spark.sparkContext.defaultParallelism
        self.send(rows.repartition(batches * each))
        return records.FolderRecords(self.source.root, files_per_trigger=each)

    def run(self, source=None) -> ingest.Totals:
        return ingest.run(self.spark, self.specs, source or self.source, self.settings)

    def events(self) -> DataFrame:
        return tables.read(self.spark, tables.EVENTS, *[s.target for s in self.specs])

    def rejects(self) -> DataFrame:
        return tables.read(self.spark, tables.REJECTS, self.rejects_at)


def _event_rows(df: DataFrame) -> DataFrame:
    return df.select("id", "datetime", "schema_name", text("rawdata"))


def _shared(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, bool]:
    """Where queries of one session that read the same tables find them, and whether they are there."""
    told = hashlib.md5(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()[:12]
    root = f"{shared_root(spark)}/tidewire/shared-{told}-{name}"
    return root, paths.exists(spark, f"{root}/whole")


def lake(spark: SparkSession, sf_dir: str, kind: str) -> Job:
    """Tables that the reports share: written once per session and test folder."""
    root, there = _shared(spark, sf_dir, kind)
    topics = (EVENT_TOPIC,) if kind == "faulty" else (EVENT_TOPIC, NOTIFICATION_TOPIC)
    job = Job(spark, topics, root=root)
    if not there:
        paths.drop_dir(spark, root)
        # A file of events may be one row group, which one task reads; all later work is dealt over the cores.
        events = fixtures.events(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)
        rows = fixtures.faulty_records(events) if kind == "faulty" else fixtures.two_topic_records(events)
        for spec in job.specs:
            ingest.ingest_batch(rows.where(F.col("topic") == spec.topic), spec, job.settings)
        paths.make_dir(spark, f"{root}/whole")
    return job


# Records, headers, decoding and routes.


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, StreamSpec]:
    spec = sample_registry("/tables", "/checkpoints")[0]
    rows = fixtures.faulty_records(fixtures.events(spark, sf_dir))
    return rows, spec


@query
def route_counts(spark, sf_dir):
    rows, spec = _parsed(spark, sf_dir)
    routed = ingest.route(ingest.parse(rows, spec), spec)
    return routed.groupBy("route").agg(F.count("*").alias("cnt"))


@query
def header_lookup(spark, sf_dir):
    rows, spec = _parsed(spark, sf_dir)
    return rows.select(
        text("key"),
        header_text("headers", SCHEMA_HEADER).alias("proto_schema"),
        ingest.header_int("headers", VERSION_HEADER).alias("proto_version"),
    )


@query
def decode_permissive(spark, sf_dir):
    rows, spec = _parsed(spark, sf_dir)
    decoded = codec.JsonCodec().decode(rows.withColumn("payload", F.col("value")), "payload", spec)
    return decoded.select(text("key"), "payload.id", "payload.datetime", "payload.name")


@query
def generated_records(spark, sf_dir):
    indexes = fixtures.events(spark, sf_dir).select((F.col("event_id") + 1).alias("index"), "ts")
    root = work_dir(spark, "generated")
    sent = generator.records(indexes, F.col("ts"))
    records.write_folder(records.placed(sent, F.col("key").cast("string").cast("bigint") - 1), root)
    spec = StreamSpec("Event", EVENT_TOPIC, "-", "-")
    return records.FolderRecords(root).batch(spark, spec).select(
        text("key"),
        text("value"),
        "topic",
        header_text("headers", SCHEMA_HEADER).alias("proto_schema"),
        header_text("headers", VERSION_HEADER).alias("proto_version"),
        F.size("headers").alias("headers"),
        "offset",
    )


# The ingest job.


def _streamed(spark: SparkSession, sf_dir: str, **settings) -> tuple[Job, ingest.Totals]:
    job = Job(spark, **settings)
    job.send(fixtures.faulty_records(fixtures.events(spark, sf_dir)))
    return job, job.run()


@query
def ingest_valid(spark, sf_dir):
    return _event_rows(_streamed(spark, sf_dir)[0].events())


@query
def ingest_dlq(spark, sf_dir):
    rejects = _streamed(spark, sf_dir)[0].rejects()
    return rejects.select("failed_at", "schema_name", text("rawdata"), "reason")


@query
def required_null(spark, sf_dir):
    rejects = lake(spark, sf_dir, "faulty").rejects().where(F.col("reason") == "required_null")
    return rejects.select("failed_at", "schema_name", text("rawdata"))


@query
def ingest_fanout(spark, sf_dir):
    job, _ = _streamed(spark, sf_dir)
    both = job.events().select(F.lit("events").alias("sink"), "rawdata").unionByName(
        job.rejects().select(F.lit("rejects").alias("sink"), "rawdata")
    )
    return both.groupBy("sink").agg(F.count("*").alias("cnt"), F.sum(F.octet_length("rawdata")).alias("bytes"))


@query
def ingest_totals(spark, sf_dir):
    job = Job(spark)
    # The totals span several micro-batches.
    totals = job.run(job.send_in(fixtures.faulty_records(fixtures.events(spark, sf_dir)), 4))
    name = job.specs[0].query_name
    counts = [(name, route, n) for route, n in sorted(totals.routes(name).items())]
    return spark.createDataFrame(counts, "query string, route string, cnt bigint")


@query
def registry_fanout(spark, sf_dir):
    job = Job(spark, (EVENT_TOPIC, NOTIFICATION_TOPIC))
    job.send(fixtures.two_topic_records(fixtures.events(spark, sf_dir)))
    job.run()
    return _event_rows(reduce(DataFrame.unionByName, [tables.read(spark, tables.EVENTS, s.target) for s in job.specs]))


@query
def one_query_fails(spark, sf_dir):
    job = Job(spark, (EVENT_TOPIC, NOTIFICATION_TOPIC))
    job.send(fixtures.two_topic_records(fixtures.events(spark, sf_dir)))

    class BrokenPayload(codec.JsonCodec):
        def decode(self, df, value, spec, out="payload"):
            fails = F.raise_error(F.lit("no such message")) if spec.schema_name == "Notification" else F.col(value)
            return super().decode(df.withColumn(value, fails.cast("binary")), value, spec, out)

    job.settings = ingest.IngestSettings(job.rejects_at, codec=BrokenPayload(), failed_at=record_time, rebalance=True)
    try:
        totals, failures = job.run(), {}
    except ingest.IngestFailed as failed:
        totals, failures = failed.totals, failed.failures
    outcome = [(s.query_name, s.query_name in failures, totals.rows(s.query_name)) for s in job.specs]
    return spark.createDataFrame(outcome, "query string, failed boolean, cnt bigint")


@query
def resume_no_dup(spark, sf_dir):
    job = Job(spark)
    rows = fixtures.faulty_records(fixtures.events(spark, sf_dir))
    early = F.col("timestamp") < F.lit(datetime(2024, 1, 15)).cast("timestamp")
    job.send(rows.where(early))
    job.run()
    job.send(rows.where(~early))
    job.run()
    job.run()
    return _event_rows(job.events())


@query
def replay_idempotent(spark, sf_dir):
    job = Job(spark, idempotent=True, failed_at=None)
    spec = job.specs[0]
    batch = ingest.parse(fixtures.faulty_records(fixtures.events(spark, sf_dir)), spec)
    write = ingest.batch_writer(spec, job.settings, ingest.Totals(), query_id="stream")
    write(batch, 0)
    write(batch, 0)
    events = job.events().select(F.lit("events").alias("sink"), text("rawdata"), F.col("datetime").alias("at"))
    rejects = job.rejects().select(F.lit("rejects").alias("sink"), text("rawdata"), F.col("failed_at").alias("at"))
    return events.unionByName(rejects)


@query
def start_latest(spark, sf_dir):
    job = Job(spark)
    rows = fixtures.faulty_records(fixtures.events(spark, sf_dir))
    early = F.col("timestamp") < F.lit(datetime(2024, 1, 15)).cast("timestamp")
    latest = records.FolderRecords(job.source.root, starting="latest")
    job.send(rows.where(early))
    job.run(latest)
    job.send(rows.where(~early))
    job.run(latest)
    return _event_rows(job.events())


@query
def stream_dedup(spark, sf_dir):
    job = Job(spark)
    rows = fixtures.faulty_records(fixtures.events(spark, sf_dir))
    ledger = dedup.OffsetLedger(f"{job.root}/ledger")
    target = f"{job.root}/unique"
    # Every record twice, in micro-batches of two runs: repeats come within a batch, after it, and after a restart.
    spread = F.pmod(F.xxhash64("key"), F.lit(3))
    for sent in (rows.where(spread < 2).unionAll(rows.where(spread == 0)), rows.where(spread > 0).unionAll(rows.where(spread == 2))):
        source = job.send_in(sent, 2)
        write_once(source.stream(spark, job.specs[0]), target, ledger, f"{job.root}/checkpoints/unique")
    return spark.read.parquet(target).select("partition", "offset", text("key"))


# Reports over the tables.


@query
def dlq_recent(spark, sf_dir):
    return reports.recent_rejects(lake(spark, sf_dir, "faulty").rejects(), AS_OF)


@query
def counts_by_type(spark, sf_dir):
    return reports.counts_by_type(spark, lake(spark, sf_dir, "types").specs, AS_OF)


@query
def dlq_by_reason(spark, sf_dir):
    counted = reports.rejects_by_reason(lake(spark, sf_dir, "faulty").rejects())
    return counted.withColumn("failed_at_day", text("failed_at_day"))


@query
def all_events_view(spark, sf_dir):
    reports.all_events(spark, lake(spark, sf_dir, "types").specs, view="all_events")
    return spark.sql(
        "SELECT schema_name, string(datetime_day) AS datetime_day, count(*) AS cnt, min(id) AS first_id, max(id) AS last_id "
        "FROM all_events GROUP BY schema_name, datetime_day"
    )


@query
def dedup_events(spark, sf_dir):
    job = Job(spark, purpose="twice")
    rows = fixtures.faulty_records(fixtures.events(spark, sf_dir))
    for _ in range(2):
        ingest.ingest_batch(rows, job.specs[0], job.settings)
    return _event_rows(dedup.first_copies(job.events().select(*tables.EVENTS.names)))


@query
def dlq_replay(spark, sf_dir):
    job = lake(spark, sf_dir, "faulty")
    again = reports.replay(job.rejects(), job.specs[0])
    return again.select("was", "reason", "schema_name", text("rawdata"), "payload.id", F.col("event_time").alias("datetime"))


@query
def partition_prune(spark, sf_dir):
    rows = tables.of_schema(lake(spark, sf_dir, "types").events(), tables.EVENTS, "Event")
    return _event_rows(tables.after(rows, tables.EVENTS, tables.moment(datetime(2024, 1, 20))))


def _own_table(spark: SparkSession, sf_dir: str) -> str:
    """A table that a query may change: all events, of both types."""
    job = Job(spark, (EVENT_TOPIC, NOTIFICATION_TOPIC), "changed")
    rows = fixtures.two_topic_records(fixtures.events(spark, sf_dir))
    target = job.specs[0].target
    for spec in job.specs:
        ingest.ingest_batch(rows.where(F.col("topic") == spec.topic), replace(spec, target=target), job.settings)
    return target


@query
def cow_upsert(spark, sf_dir):
    target = _own_table(spark, sf_dir)
    # Purchases move by a day; errors are new as notifications, beside the events of their id.
    events = fixtures.events(spark, sf_dir).where(F.col("event_type").isin("purchase", "error"))
    changes = events.select(
        F.col("event_id").alias("id"),
        (F.col("ts") + F.expr("interval 1 day")).alias("datetime"),
        F.lit("Notification").alias("schema_name"),
        F.lit("changed").cast("binary").alias("rawdata"),
    )
    rewrite.upsert(spark, target, tables.EVENTS, changes)
    return _event_rows(tables.read(spark, tables.EVENTS, target))


@query
def cow_delete(spark, sf_dir):
    target = _own_table(spark, sf_dir)
    # Two whole days, and one hour of every other day.
    rewrite.delete_where(
        spark, target, tables.EVENTS,
        (F.col("datetime") < F.lit(datetime(2024, 1, 3)).cast("timestamp")) | (F.hour("datetime") == 5),
    )
    return _event_rows(tables.read(spark, tables.EVENTS, target))


@query
def cow_update(spark, sf_dir):
    target = _own_table(spark, sf_dir)
    rewrite.update_where(
        spark, target, tables.EVENTS, F.hour("datetime") >= 18,
        {"datetime": F.col("datetime") + F.expr("interval 12 hours"), "rawdata": F.lit("late").cast("binary")},
    )
    return _event_rows(tables.read(spark, tables.EVENTS, target))


@query
def consumer_lag(spark, sf_dir):
    events = fixtures.events(spark, sf_dir)
    half = events.count() / 2
    rows = fixtures.faulty_records(events)
    read = rows.where(F.col("key").cast("string").cast("bigint") < half).withColumn("consumergroup", F.lit("group-a"))
    return lag.consumer_lag(lag.next_offsets(rows), lag.next_offsets(read, "consumergroup"))


# Metrics.

HOURLY = ranges.Grid(datetime(2024, 1, 1, 6), datetime(2024, 1, 31), timedelta(hours=6))


def _chunks(spark: SparkSession, sf_dir: str, board: str, metrics: Iterable[str]) -> DataFrame:
    """Chunks of samples of a dashboard's targets, of some metrics.

    They lie in a table per session and test folder, to which a metric is added when it is first asked for.
    """
    root, _ = _shared(spark, sf_dir, f"samples-{board}")
    metrics = sorted(metrics)
    lacking = [m for m in metrics if not paths.exists(spark, f"{root}/whole/{m}")]
    if lacking:
        for metric in lacking:
            paths.drop_dir(spark, f"{root}/samples/metric={metric}")
        samples.write_chunks(fixtures.scrape_samples(fixtures.events(spark, sf_dir), board, lacking), f"{root}/samples")
        # Without events there are no folders.
        for metric in lacking:
            paths.make_dir(spark, f"{root}/samples/metric={metric}")
            paths.make_dir(spark, f"{root}/whole/{metric}")
    return samples.read_chunks(spark, f"{root}/samples", metrics)


def _scraped(spark: SparkSession, sf_dir: str, board: str, metrics: Iterable[str] | None = None) -> DataFrame:
    """Samples of a dashboard's targets, of all its metrics or of some."""
    if metrics is None:
        metrics = {p.metric for _, p in panels.dashboard(board)} | {v.metric for v in panels.VARIABLES if v.dashboard == board}
    return samples.of_chunks(_chunks(spark, sf_dir, board, metrics))


def _scrape_end(spark: SparkSession, sf_dir: str) -> datetime:
    last = fixtures.events(spark, sf_dir).agg(F.max("event_id")).first()[0]
    start = datetime.fromisoformat(fixtures.SCRAPE_START)
    return start + timedelta(seconds=last // fixtures.SLOTS * fixtures.SCRAPE_SECONDS)


def _scrape_grid(spark: SparkSession, sf_dir: str, step: int = 60) -> ranges.Grid:
    start = datetime.fromisoformat(fixtures.SCRAPE_START)
    return ranges.Grid(start, _scrape_end(spark, sf_dir), timedelta(seconds=step))


def _panel(number: int) -> Query:
    def run(spark, sf_dir):
        panel = panels.PANELS[number - 1]
        rows = _scraped(spark, sf_dir, panel.dashboard, [panel.metric])
        return rounded(panels.evaluate(rows, panel, _scrape_grid(spark, sf_dir), CHOSEN))

    return run


# One panel for each kind of expression.
QUERIES["metric_count"] = _panel(1)
QUERIES["metric_sum"] = _panel(2)
QUERIES["metric_bool"] = _panel(8)
QUERIES["metric_delta"] = _panel(10)
QUERIES["metric_sum_by"] = _panel(11)
QUERIES["metric_irate"] = _panel(33)
QUERIES["metric_percent"] = _panel(44)


@query
def metric_raw(spark, sf_dir):
    return _panel(49)(spark, sf_dir).select(label_text().alias("labels"), "legend", "ts", "value")


@query
def metric_increase(spark, sf_dir):
    counters = fixtures.hourly_counters(fixtures.events(spark, sf_dir))
    grown = ranges.increase(counters, HOURLY, timedelta(hours=6))
    return rounded(grown.select(label("event_type").alias("event_type"), "ts", "value"))


@query
def metric_rate(spark, sf_dir):
    counters = fixtures.hourly_counters(fixtures.events(spark, sf_dir))
    rates = ranges.rate(counters, HOURLY, timedelta(hours=6))
    return rounded(rates.select(label("event_type").alias("event_type"), "ts", "value"))


@query
def metric_range(spark, sf_dir):
    metric = "kafka_topic_partition_current_offset"
    rows = samples.scan(_scraped(spark, sf_dir, "exporter", [metric]), metric)
    grid = ranges.Grid.last_hour(_scrape_end(spark, sf_dir))
    rates = ranges.rate(rows, grid, timedelta(minutes=5))
    named = rates.withColumn("name", legend("{{topic}}:{{partition}}"))
    return rounded(named.select("name", "ts", "value"))


@query
def label_match(spark, sf_dir):
    metric = "kafka_consumergroup_lag"
    rows = samples.scan(_scraped(spark, sf_dir, "exporter", [metric]), metric)
    chosen = matches(
        [
            Matcher("topic", "=~", "topic-[0-2]"),
            Matcher("consumergroup", "=", "group-1"),
            Matcher("partition", "!=", "2"),
            Matcher("listener", "=", ""),
        ]
    )
    return rounded(rows.where(chosen).select(label("topic").alias("topic"), label("partition").alias("partition"), "ts", "value"))


@query
def label_values(spark, sf_dir):
    def lists_of(board: str) -> DataFrame:
        rows = _chunks(spark, sf_dir, board, {v.metric for v in panels.VARIABLES if v.dashboard == board})
        return panels.all_choices(rows, board, CHOSEN).select(F.lit(board).alias("dashboard"), "variable", "value")

    lists = [lists_of(b) for b in ("exporter", "broker")]
    return reduce(DataFrame.unionByName, lists).orderBy("dashboard", "variable", "value")


@query
def metric_scan(spark, sf_dir):
    path = work_dir(spark, "samples")
    samples.write(relabel.relabel_pods(fixtures.pod_targets(fixtures.events(spark, sf_dir)), drop_meta=True), path)
    found = samples.scan(
        samples.read(spark, path), "up", datetime(2024, 1, 10), datetime(2024, 1, 25),
        {"strimzi_io_kind": relabel.SCRAPED_KINDS},
    )
    return rounded(
        found.select(label("strimzi_io_kind").alias("kind"), label("kubernetes_pod_name").alias("pod"), "ts", "value")
    )


@query
def offset_table(spark, sf_dir):
    panel = panels.PANELS[11]
    rows = _scraped(spark, sf_dir, "exporter", [panel.metric])
    current = panels.evaluate(rows, panel, ranges.Grid.at(_scrape_end(spark, sf_dir)), CHOSEN)
    table = current.select("ts", "consumergroup", "partition", "topic", "value")
    return rounded(aggregates.top_rows(table, column=3))


def _dashboard(name: str) -> Query:
    def run(spark, sf_dir):
        chunks = _chunks(spark, sf_dir, name, {p.metric for _, p in panels.dashboard(name)})
        grid, rows = _scrape_grid(spark, sf_dir), samples.of_chunks(chunks)
        return rounded(panels.evaluate_all(rows, grid, panels.dashboard(name), CHOSEN, chunks))

    return run


for _name in ("exporter", "broker", "operators"):
    QUERIES[f"dashboard_{_name}"] = _dashboard(_name)


@query
def metric_pipeline(spark, sf_dir):
    path = work_dir(spark, "metric-job")
    # A file of events may be one row group, which one task reads; their beans are made on all cores.
    events = fixtures.events(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
    metric_job.collect(fixtures.scraped_beans(events), path)
    idle = panels.PANELS[43]
    return rounded(panels.evaluate(samples.read(spark, path, [idle.metric]), idle, _scrape_grid(spark, sf_dir), CHOSEN))


# Shaping of metrics and logs.


@query
def jmx_normalize(spark, sf_dir):
    beans = fixtures.beans(fixtures.events(spark, sf_dir))
    rules = (*naming.BROKER_RULES, *naming.REBALANCER_RULES)
    named = naming.normalize(beans, rules)
    return named.select("event_id", "metric", "kind", label_text().alias("labels"))


def relabel_targets(spark, sf_dir):
    named = relabel.relabel_pods(fixtures.pod_targets(fixtures.events(spark, sf_dir)))
    return named.select("event_id", label_text().alias("labels"))


QUERIES["relabel"] = relabel_targets


@query
def log_lines(spark, sf_dir):
    root = work_dir(spark, "logs")
    lines = fixtures.log_lines(fixtures.events(spark, sf_dir))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    lines.select(F.concat_ws(" ", time, "stream", F.lit("F"), "log").alias("value")).write.text(f"{root}/files")
    log_source.collect_new(spark, f"{root}/files", f"{root}/lines", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/lines").select("ts", "stream", "partial", "log")


@query
def log_multiline(spark, sf_dir):
    # A file of documents may be one row group, which one task reads; its texts are cut on all cores.
    documents = fixtures.documents(spark, sf_dir).select("doc_id", "source", "text")
    documents = documents.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    joined = logs.join_partials(fixtures.text_pieces(documents), F.col("block"))
    return joined.select("path", "stream", "ts", "log", "complete")


@query
def log_merge(spark, sf_dir):
    merged = logs.merge_json(fixtures.log_lines(fixtures.events(spark, sf_dir)))
    fields = F.col("fields")
    return merged.select("event_id", "log", fields["id"].alias("id"), fields["event"].alias("event"))


@query
def log_enriched(spark, sf_dir):
    events = fixtures.events(spark, sf_dir)
    rich = logs.with_pod(fixtures.log_lines(events), fixtures.pods(events))
    return rich.select("event_id", "namespace", "pod_name", "container", "node_name", "app")


@query
def log_streams(spark, sf_dir):
    events = fixtures.events(spark, sf_dir)
    target = work_dir(spark, "streams")
    log_source.write_streams(logs.with_pod(fixtures.log_lines(events), fixtures.pods(events)), target, "logs-")
    return spark.read.parquet(target).groupBy("namespace", "pod_name", "log_stream").agg(F.count("*").alias("cnt"))


@query
def log_pipeline(spark, sf_dir):
    events = fixtures.events(spark, sf_dir)
    root = work_dir(spark, "log-job")
    lines = fixtures.container_lines(events)
    # The first run finds the files as they were halfway, one of them in the middle of a message.
    half = F.lit(events.count() // 2)
    early = (F.col("event_id") < half) | ((F.col("event_id") == half) & (F.col("n") == 0))
    for written in (lines.where(early), lines):
        fixtures.write_container_files(written, f"{root}/files")
        log_job.collect(spark, f"{root}/files", f"{root}/streams", f"{root}/state", fixtures.pods(events), "logs-")
    found = spark.read.parquet(f"{root}/streams")
    return found.select(
        "ts", "stream", "namespace", "pod_name", "log_stream", "node_name", "app", "log",
        F.col("fields")["id"].alias("id"), F.col("fields")["event"].alias("event"), "complete",
    )


@query
def log_tail(spark, sf_dir):
    """What three runs read: of files as they grow, of renamed ones, and of those that began anew."""
    events = fixtures.events(spark, sf_dir)
    root = work_dir(spark, "log-tail")
    lines = fixtures.container_lines(events)
    third = -(-events.count() // 3)
    fixtures.write_container_files(lines.where(F.col("event_id") < third), f"{root}/files", third)
    read = [("first", log_source.appended(spark, f"{root}/files", spark.createDataFrame([], log_source.POSITIONS)))]
    # All grow; then some are renamed, and others begin under the names they had.
    fixtures.write_container_files(lines.where(F.col("event_id") < 2 * third), f"{root}/files", 2 * third)
    read.append(("grown", log_source.appended(spark, f"{root}/files", read[-1][1][1])))
    names = sorted(paths.children(spark, f"{root}/files/range=0"))
    logs_there = [n for n in names if n.endswith(".log")]
    for name in logs_there[::2]:
        paths.move(spark, f"{root}/files/range=0/{name}", f"{root}/files/range=0/rotated-{name}")
    rest = lines.where(F.col("event_id") >= 2 * third)
    began_anew = F.col("name").isin(logs_there[::4])
    whole = lines.where(~F.col("name").isin(logs_there[::2])).unionByName(rest.where(began_anew))
    fixtures.write_container_files(whole, f"{root}/files", events.count())
    fixtures.write_container_files(rest.where(F.col("name").isin(logs_there[2::4])), f"{root}/more", events.count())
    for name in logs_there[2::4]:
        paths.move(spark, f"{root}/more/range=0/{name}", f"{root}/files/range=1/{name}")
    read.append(("moved", log_source.appended(spark, f"{root}/files", read[-1][1][1])))
    found = [lines.select(F.lit(run).alias("run"), "value") for run, (lines, _) in read]
    return reduce(DataFrame.unionByName, found)


@query
def log_latest_streams(spark, sf_dir):
    return logs.latest_streams(fixtures.log_lines(fixtures.events(spark, sf_dir)))


@query
def log_recent(spark, sf_dir):
    recent = logs.recent(fixtures.log_lines(fixtures.events(spark, sf_dir)), datetime(2024, 1, 20))
    return recent.select("ts", "path", "log")
