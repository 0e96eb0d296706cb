import os
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import codec
from tidewire.operators import dedup, lag
from tidewire.plans import tables
from tidewire.plans.queries import QUERIES, Job
from tidewire.registry import EVENT_TOPIC, NOTIFICATION_TOPIC, ProducerSpec, StreamSpec, event_payload
from tidewire.sources import fixtures, generator, records
from tidewire.streaming import ingest

GOLDEN = {
    "ok": 350, "missing_schema": 150, "missing_version": 150, "schema_mismatch": 150,
    "deserialize_error": 100, "unsupported_version": 50, "required_null": 50,
}


def faulty(spark, sf):
    return fixtures.faulty_records(fixtures.events(spark, sf))


def test_golden_route_counts(spark):
    rows = QUERIES["route_counts"](spark, "/root/testdata/sf0.01").collect()
    assert {r.route: r.cnt for r in rows} == {k: 10 * v for k, v in GOLDEN.items()}


def test_stream_equals_batch_and_restart_adds_nothing(spark, sf):
    stream, batch = Job(spark), Job(spark)
    stream.send(faulty(spark, sf))
    first = stream.run()
    second = stream.run()
    assert dict(first.routes("consumer-Event")) == GOLDEN
    assert second.rows("consumer-Event") == 0
    ingest.ingest_batch(faulty(spark, sf), batch.specs[0], batch.settings)
    for read in (Job.events, Job.rejects):
        a, b = read(stream), read(batch)
        assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_totals_sum_all_micro_batches(spark, sf):
    job = Job(spark)
    job.send(faulty(spark, sf).repartition(3))
    totals = job.run(records.FolderRecords(job.source.root, files_per_trigger=1))
    assert len(totals.batches["consumer-Event"]) == 3
    assert totals.rows("consumer-Event") == 1000


def test_a_failing_stream_does_not_hide_the_others(spark, sf):
    job = Job(spark, (EVENT_TOPIC, NOTIFICATION_TOPIC))
    job.send(fixtures.two_topic_records(fixtures.events(spark, sf)))
    # The notification table cannot be made.
    broken = StreamSpec("Notification", NOTIFICATION_TOPIC, "/dev/null/table", job.specs[1].checkpoint)
    job.specs = [broken, job.specs[0]]
    with pytest.raises(ingest.IngestFailed) as failed:
        job.run()
    assert list(failed.value.failures) == ["consumer-Notification"]
    good = fixtures.events(spark, sf).where(~F.col("event_type").isin("purchase", "signup")).count()
    assert failed.value.totals.rows("consumer-Event") == good
    assert tables.read(spark, tables.EVENTS, job.specs[1].target).count() == good


def test_missing_topic_folder_is_a_failure_of_that_stream_only(spark, sf):
    job = Job(spark, (EVENT_TOPIC, NOTIFICATION_TOPIC))
    job.send(faulty(spark, sf))
    with pytest.raises(ingest.IngestFailed) as failed:
        job.run()
    assert list(failed.value.failures) == ["consumer-Notification"]
    assert failed.value.totals.rows("consumer-Event") == 1000


def test_open_topic_lets_a_stream_wait_for_records(spark, sf):
    job = Job(spark)
    records.open_topic(spark, job.source.root, EVENT_TOPIC)
    assert job.run().rows("consumer-Event") == 0
    job.send(faulty(spark, sf))
    assert job.run().rows("consumer-Event") == 1000


def test_latest_passes_over_what_is_there(spark, sf):
    job = Job(spark)
    latest = records.FolderRecords(job.source.root, starting="latest")
    job.send(faulty(spark, sf))
    assert job.run(latest).rows("consumer-Event") == 0
    job.send(faulty(spark, sf).limit(7))
    assert job.run(latest).rows("consumer-Event") == 7
    assert job.run(latest).rows("consumer-Event") == 0


def test_lost_commit_replays_the_batch(spark, sf):
    """At-least-once by default; the idempotent mode repeats nothing."""
    sizes = {}
    for idempotent in (False, True):
        job = Job(spark, idempotent=idempotent, failed_at=None)
        job.send(faulty(spark, sf))
        job.run()
        commits = f"{job.specs[0].checkpoint}/commits"
        for name in os.listdir(commits):
            os.remove(f"{commits}/{name}")
        job.run()
        sizes[idempotent] = (job.events().count(), job.rejects().count())
    assert sizes == {False: (700, 1300), True: (350, 650)}


def test_no_rejects_means_no_reject_files(spark, sf):
    job = Job(spark)
    job.send(fixtures.two_topic_records(fixtures.events(spark, sf)).where(F.col("topic") == EVENT_TOPIC))
    job.run()
    assert os.listdir(job.rejects_at) == []


@pytest.mark.parametrize("rebalance", [False, True])
def test_clean_batches_are_read_once_and_nothing_is_cached(spark, sf, folder, rebalance, monkeypatch):
    """Rows are counted by what is written; only rejects need a second write."""
    writes, plans = [], []
    real = tables.append

    def spy(df, target, *args, **kwargs):
        writes.append(target)
        plans.append(df._jdf.queryExecution().toString())
        return real(df, target, *args, **kwargs)

    monkeypatch.setattr(tables, "append", spy)
    spec = StreamSpec("Event", "t", f"{folder}/e", f"{folder}/c")
    settings = ingest.IngestSettings(f"{folder}/d", rebalance=rebalance)
    rows = faulty(spark, sf)
    fine = rows.where("cast(cast(key as string) as int) % 20 = 16")
    bad = rows.where("cast(cast(key as string) as int) % 20 in (0, 7)")
    assert ingest.ingest_batch(fine, spec, settings).routes("consumer-Event") == {"ok": 50}
    assert writes == [spec.target]
    assert ingest.ingest_batch(bad, spec, settings).routes("consumer-Event") == {"missing_schema": 50, "deserialize_error": 50}
    assert ingest.ingest_batch(rows.where("1 = 0"), spec, settings).rows("consumer-Event") == 0
    both = ingest.ingest_batch(fine.unionAll(bad), spec, settings).routes("consumer-Event")
    assert both == {"ok": 50, "missing_schema": 50, "deserialize_error": 50}
    assert all("InMemoryRelation" not in p for p in plans)
    # From a record to a row the payload is parsed once.
    assert plans[0][plans[0].index("Physical Plan"):].count("from_json(") == 1


def test_totals_outlive_the_job(spark, sf, monkeypatch):
    job = Job(spark, idempotent=True, failed_at=None, progress=None)
    job.settings = replace(job.settings, progress=f"{job.root}/progress")
    job.send(faulty(spark, sf).repartition(3))
    source = records.FolderRecords(job.source.root, files_per_trigger=1)
    real, calls = tables.append, []

    def breaking(*args, **kwargs):
        calls.append(1)
        if len(calls) == 4:
            raise OSError("no more space")
        return real(*args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(tables, "append", breaking)
        with pytest.raises(ingest.IngestFailed):
            job.run(source)
    left = job.run(source)
    stored = ingest.Totals.stored(spark, job.settings.progress, ["consumer-Event", "consumer-Other"])
    assert left.rows("consumer-Event") < stored.rows("consumer-Event") == 1000
    whole = faulty(spark, sf)
    spec = job.specs[0]
    counted = ingest.route(ingest.parse(whole, spec), spec).groupBy("route").count().collect()
    assert stored.routes("consumer-Event") == {r["route"]: r["count"] for r in counted}
    assert stored.rows("consumer-Other") == 0


def test_whatever_stops_a_start_the_other_streams_are_awaited(spark, sf):
    job = Job(spark, (EVENT_TOPIC, NOTIFICATION_TOPIC))
    job.send(fixtures.two_topic_records(fixtures.events(spark, sf)))

    class Odd(records.FolderRecords):
        def stream(self, session, spec):
            if spec.schema_name == "Event":
                raise KeyError
            return super().stream(session, spec)

    with pytest.raises(ingest.IngestFailed) as failed:
        job.run(Odd(job.source.root))
    assert set(failed.value.failures) == {"consumer-Event"}
    assert failed.value.totals.rows("consumer-Notification") == job.events().count() > 0
    assert not spark.streams.active


def test_a_broken_off_first_start_at_the_latest_loses_and_repeats_nothing(spark, sf, monkeypatch):
    job = Job(spark)
    latest = records.FolderRecords(job.source.root, starting="latest")
    seed = job.specs[0].checkpoint + ".seed"
    job.send(faulty(spark, sf).limit(20))
    # The job ends while it lists the files: the list has no mark.
    listed = latest._list(spark, latest.folder(EVENT_TOPIC)).limit(1)
    listed.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(seed)
    # The next one ends in its first micro-batch, after the list was made.
    assert job.run(latest).rows("consumer-Event") == 0
    job.send(faulty(spark, sf).limit(7))
    with monkeypatch.context() as patch:
        patch.setattr(tables, "append", lambda *a, **k: 1 / 0)
        with pytest.raises(ingest.IngestFailed):
            job.run(latest)
    job.send(faulty(spark, sf).limit(5))
    assert job.run(latest).rows("consumer-Event") == 12
    assert job.run(latest).rows("consumer-Event") == 0


def test_files_of_the_start_are_skipped_by_the_scan(spark, sf):
    job = Job(spark)
    latest = records.FolderRecords(job.source.root, starting="latest")
    job.send(faulty(spark, sf).limit(20))
    spec = job.specs[0]
    condition = latest._is_new(spark, spec)
    job.send(faulty(spark, sf).limit(3))
    found = spark.read.schema(records.RECORD_SCHEMA).parquet(latest.folder(spec.topic)).where(condition)
    assert found.count() == 3


def test_a_hundred_entries(spark, sf, folder):
    """The design point of the registry: a hundred streams on one session, some at a time."""
    events = fixtures.events(spark, sf)
    rows = fixtures.two_topic_records(events).withColumn("topic", F.concat(F.lit("topic-"), F.col("key").cast("string").cast("int") % 100))
    rows = rows.withColumn("headers", F.array(*[F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in (("proto-schema", F.concat(F.lit("Type"), F.col("key").cast("string").cast("int") % 100)), ("proto-version", F.lit("1")))]))
    records.write_folder(rows.repartition(1), f"{folder}/r")
    specs = [StreamSpec(f"Type{n}", f"topic-{n}", f"{folder}/t/{n}", f"{folder}/c/{n}") for n in range(100)]
    totals = ingest.run(spark, specs, records.FolderRecords(f"{folder}/r"), ingest.IngestSettings(f"{folder}/d", rebalance=True), at_once=16)
    assert [totals.routes(s.query_name) for s in specs] == [{"ok": 10}] * 100
    assert not spark.streams.active


def test_failed_at_is_the_processing_time_by_default(spark, sf):
    job = Job(spark, failed_at=None)
    job.send(faulty(spark, sf))
    before = datetime.now().astimezone()
    job.run()
    oldest = job.rejects().agg(F.min(F.unix_seconds("failed_at"))).first()[0]
    assert oldest >= int(before.timestamp())


def test_bounded_generator(spark):
    producers = [ProducerSpec("a", event_payload, "A", 1), ProducerSpec("b", event_payload, "B", 2)]
    sent = generator.records(generator.bounded(spark), producers=producers).collect()
    assert len(sent) == 20
    assert {bytes(r.key) for r in sent} == {str(i).encode() for i in range(1, 11)}
    headers = {r.topic: [(h.key, bytes(h.value)) for h in r.headers] for r in sent}
    assert headers["b"] == [("proto-schema", b"B"), ("proto-version", b"2")]
    one = next(r for r in sent if r.topic == "a" and bytes(r.key) == b"3")
    assert b'"name":"hello from producer #3"' in bytes(one.value)


def test_unbounded_generator(spark, folder):
    stream = generator.records(generator.unbounded(spark, 0.01))
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(processingTime="10 milliseconds").start(f"{folder}/o")
    )
    try:
        while query.lastProgress is None or query.lastProgress["batchId"] < 3:
            assert query.exception() is None
            query.awaitTermination(1)
    finally:
        query.stop()
    keys = sorted(int(bytes(r.key)) for r in spark.read.parquet(f"{folder}/o").collect())
    assert keys[:3] == [1, 2, 3] and keys == list(range(1, len(keys) + 1))


def test_first_copies(spark):
    rows = [("Event", 1, "b"), ("Event", 1, "a"), ("Event", 2, "c"), ("Other", 1, "d")] * 50
    out = dedup.first_copies(spark.createDataFrame(rows, "schema_name string, id bigint, rawdata string"))
    assert sorted(map(tuple, out.collect())) == [("Event", 1, "a"), ("Event", 2, "c"), ("Other", 1, "d")]
    # Copies are reduced before they are shuffled.
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in text and "Window" not in text


def test_lag_of_the_documented_case(spark):
    sent = spark.range(100).select(F.lit("test-topic").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), F.expr("id div 3").alias("offset"))
    read = sent.where("partition * 34 + offset < 50").withColumn("consumergroup", F.lit("test-group"))
    lags = lag.consumer_lag(lag.next_offsets(sent), lag.next_offsets(read, "consumergroup"))
    known = lags.agg(F.sum("lag"), F.sum("committed"), F.sum("log_end")).first()
    # Partition 2 was never read: its committed offset and lag are unknown.
    assert known[2] == 100 and known[1] == 50
    assert lags.where("committed IS NULL").count() == 1


def test_first_deliveries_needs_coordinates(spark):
    with pytest.raises(ValueError):
        dedup.first_deliveries(spark.range(1))


def test_command_line(spark, folder):
    from tidewire import __main__ as cli

    cli.produce(spark, cli.parse_args(["produce", "--folder", f"{folder}/r", "--count", "12"]))
    args = cli.parse_args(["ingest", "--folder", f"{folder}/r", "--tables", f"{folder}/t", "--checkpoints", f"{folder}/c"])
    assert args.starting_offsets == "earliest"
    assert dict(cli.consume(spark, args).routes("consumer-Event")) == {"ok": 12}
    assert cli.consume(spark, args).rows("consumer-Event") == 0
    for wrong in (["ingest", "--folder", "r", "--tables", "t"], ["produce", "--servers", "s", "--infinite"], ["produce"]):
        with pytest.raises(SystemExit):
            cli.parse_args(wrong)


def test_command_line_with_protobuf_and_replayable_writes(spark, folder):
    from tidewire import __main__ as cli
    from tidewire.functions.codec import JsonCodec, ProtobufCodec

    with open(f"{folder}/events.desc", "wb") as file:
        file.write(b"\x0a\x03abc")
    ingest_args = ["ingest", "--folder", f"{folder}/r", "--tables", f"{folder}/t", "--checkpoints", f"{folder}/c"]
    plain = cli.parse_args(ingest_args)
    coded = cli.parse_args([*ingest_args, "--descriptor", f"{folder}/events.desc", "--package", "a.b"])
    assert isinstance(cli.codec(spark, plain), JsonCodec)
    assert cli.codec(spark, coded) == ProtobufCodec(b"\x0a\x03abc")
    cli.produce(spark, cli.parse_args(["produce", "--folder", f"{folder}/r", "--count", "5"]))
    kept = ["--ledger", f"{folder}/l", "--progress", f"{folder}/p", "--at-once", "1"]
    again = cli.parse_args([*ingest_args, "--idempotent", "--rebalance", *kept])
    assert dict(cli.consume(spark, again).routes("consumer-Event")) == {"ok": 5}
    # Nothing new: the totals are those of the run before.
    assert dict(cli.consume(spark, again).routes("consumer-Event")) == {"ok": 5}
    catalog = ["ingest", "--folder", "r", "--tables", "cat.events", "--checkpoints", "/c"]
    assert cli.parse_args([*catalog, "--idempotent"]).idempotent
    for wrong in ([*ingest_args, "--descriptor", "d"], [*ingest_args, "--package", "a"], [*catalog, "--ledger", "l"]):
        with pytest.raises(SystemExit):
            cli.parse_args(wrong)


def test_message_names_come_from_the_package():
    from tidewire.registry import sample_registry

    assert sample_registry("/t", "/c", package="a.b")[0].message == "a.b.Event"
    assert sample_registry("/t", "/c")[0].message == ""


def test_sample_registry_of_a_catalog():
    from tidewire.registry import sample_registry

    assert sample_registry("cat.events", "/c", joint=".")[0].target == "cat.events.sample_events_event"


def test_named_sets_of_records_can_run_again(spark, sf):
    job = Job(spark, idempotent=True, failed_at=None)
    spec, rows = job.specs[0], faulty(spark, sf)
    for run_id in ("a", "a", "b"):
        ingest.ingest_batch(rows, spec, job.settings, run_id)
    assert (job.events().count(), job.rejects().count()) == (700, 1300)
    with pytest.raises(ValueError, match="run_id"):
        ingest.ingest_batch(rows, spec, job.settings)


@pytest.mark.parametrize("salts", [1, 3])
def test_first_deliveries(spark, sf, folder, salts):
    rows = faulty(spark, sf)
    source = records.FolderRecords(f"{folder}/r")
    for _ in range(2):
        records.write_folder(rows.repartition(2).unionAll(rows), source.root)
    spec = StreamSpec("Event", EVENT_TOPIC, "/x", "/c")
    unique = dedup.first_deliveries(source.stream(spark, spec), "60 days", salts).select(*dedup.RECORD_KEY)
    query = (
        unique.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start(f"{folder}/o")
    )
    query.awaitTermination()
    out = spark.read.parquet(f"{folder}/o")
    assert out.count() == 1000 and out.distinct().count() == 1000


def test_each_micro_batch_has_a_file_for_each_core(spark, sf, tmp_path):
    job = Job(spark, root=str(tmp_path))
    source = job.send_in(fixtures.faulty_records(fixtures.events(spark, sf)), 3)
    cores = spark.sparkContext.defaultParallelism
    parts = list(tmp_path.glob("records/topic=*/*.parquet"))
    assert (len(parts), source.files_per_trigger) == (3 * cores, cores)


def test_rejects_are_decoded_once(spark, sf, tmp_path, monkeypatch):
    job, plans, append = Job(spark, root=str(tmp_path)), [], tables.append

    def watched(rows, target, *rest):
        plans.append((target, rows._jdf.queryExecution().optimizedPlan().toString()))
        return append(rows, target, *rest)

    monkeypatch.setattr(tables, "append", watched)
    rows = fixtures.faulty_records(fixtures.events(spark, sf))
    totals = ingest.ingest_batch(rows, job.specs[0], job.settings)
    plan = dict(plans)[job.rejects_at]
    assert "CollectMetrics" in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and "from_json" in line]
    assert job.rejects().count() == sum(n for r, n in totals.routes(job.specs[0].query_name).items() if r != "ok")
