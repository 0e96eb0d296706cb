from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import executed
from tidewire.operators import rewrite
from tidewire.plans import reports, tables
from tidewire.streaming import ingest
from tidewire.sources import fixtures, records
from tidewire.registry import sample_registry


def test_event_table_columns():
    fields = [(f.name, f.dataType, f.nullable) for f in tables.EVENTS.columns.fields]
    assert fields == [
        ("id", T.LongType(), False),
        ("datetime", T.TimestampType(), False),
        ("schema_name", T.StringType(), False),
        ("rawdata", T.BinaryType(), False),
    ]


def test_reject_table_has_reason_and_optional_schema_name():
    flags = {f.name: f.nullable for f in tables.REJECTS.columns.fields}
    assert list(flags) == ["failed_at", "schema_name", "rawdata", "reason"]
    assert flags["schema_name"] and not flags["reason"] and not flags["failed_at"]


def test_partition_order_is_schema_then_day():
    assert tables.EVENTS.partition_spec == [("schema_name", "identity"), ("datetime_day", "day")]
    assert tables.REJECTS.partition_spec == [("schema_name", "identity"), ("failed_at_day", "day")]


def test_catalog_ddl():
    sql = tables.create_sql("cat.events.sample", tables.REJECTS)
    assert "failed_at TIMESTAMP NOT NULL" in sql and "schema_name STRING,\n" in sql
    assert "PARTITIONED BY (schema_name, days(failed_at))" in sql
    assert sql.count("'copy-on-write'") == 3


def event_rows(spark, rows):
    return spark.createDataFrame(rows, tables.EVENTS.columns)


def test_scan_prunes_schema_and_day(spark, folder):
    target = f"{folder}/events"
    rows = [(d, datetime(2024, 1, d, 12), "Event", b"x") for d in range(1, 11)]
    tables.append(event_rows(spark, rows), target, tables.EVENTS)
    found = tables.after(
        tables.of_schema(tables.read(spark, tables.EVENTS, target), tables.EVENTS, "Event"),
        tables.EVENTS, tables.moment(datetime(2024, 1, 8, 12)),
    )
    assert sorted(r.id for r in found.collect()) == [9, 10]
    plan = executed(found)
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "schema_name" in filters and "datetime_day" in filters
    assert len(found.inputFiles()) >= 1


def test_utc_day_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        df = spark.range(1).select(F.timestamp_seconds(F.lit(-1)).alias("a"), F.timestamp_seconds(F.lit(86399)).alias("b"))
        row = df.select(tables.utc_day(F.col("a")).cast("string"), tables.utc_day(F.col("b")).cast("string")).first()
        assert tuple(row) == ("1969-12-31", "1970-01-01")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_conform_rejects_wrong_columns(spark):
    with pytest.raises(ValueError, match="rawdata"):
        tables.conform(spark.createDataFrame([(1,)], "id bigint"), tables.EVENTS)
    with pytest.raises(ValueError, match="id"):
        tables.conform(event_rows(spark, []).withColumn("id", F.lit("x")), tables.EVENTS)


def test_any_schema_name_can_be_rejected(spark, folder):
    """Empty, very long and path-like names must neither be lost nor break the write."""
    names = [None, "", "Event", "x" * 5000, "a/b=c", "1", "__none__"]
    rows = [(datetime(2024, 1, 1), n, None if n == "1" else b"r", "schema_mismatch") for n in names]
    target = f"{folder}/rejects"
    tables.append(spark.createDataFrame(rows, tables.REJECTS.columns), target, tables.REJECTS, known=("Event",))
    back = tables.read(spark, tables.REJECTS, target)
    assert sorted(map(str, names)) == sorted(str(r.schema_name) for r in back.collect())
    assert {r.schema_key for r in back.collect()} == {"__none__", "__other__", "Event"}
    assert tables.of_schema(back, tables.REJECTS, "1").count() == 1
    assert tables.of_schema(back, tables.REJECTS, "Event").count() == 1


def test_batch_partitions_make_appends_repeatable(spark, folder):
    target = f"{folder}/events"
    rows = event_rows(spark, [(1, datetime(2024, 1, 1), "Event", b"x")])
    for batch in (0, 0, 1):
        tables.append(rows, target, tables.EVENTS, batch=("q", batch))
    assert tables.read(spark, tables.EVENTS, target).count() == 2


def test_rebalanced_append(spark, folder):
    rows = event_rows(spark, [(i, datetime(2024, 1, 1 + i % 5), "Event", b"x") for i in range(50)])
    tables.append(rows.repartition(8), f"{folder}/a", tables.EVENTS, rebalance=True)
    back = tables.read(spark, tables.EVENTS, f"{folder}/a")
    assert back.count() == 50 and len(back.inputFiles()) <= 10


def test_recent_rejects_is_a_top_k(spark, folder):
    rows = [(datetime(2024, 1, 1 + i % 9, i % 24), "Event", b"x" * i, "schema_mismatch") for i in range(300)]
    tables.append(spark.createDataFrame(rows, tables.REJECTS.columns), f"{folder}/r", tables.REJECTS)
    top = reports.recent_rejects(tables.read(spark, tables.REJECTS, f"{folder}/r"), datetime(2024, 1, 9))
    assert "TakeOrderedAndProject" in executed(top)
    got = top.collect()
    assert got == sorted(got, key=lambda r: (-r.failed_at.timestamp(), r.schema_name, r.reason, r.bytes))
    assert all(r.failed_at > datetime(2024, 1, 8) for r in got)


def test_counts_include_types_without_rows(spark, folder):
    specs = sample_registry(folder, f"{folder}/c", ("sample-events-event", "sample-events-notification"))
    tables.append(event_rows(spark, [(1, datetime(2024, 1, 1), "Event", b"x")]), specs[0].target, tables.EVENTS)
    tables.open_table(spark, specs[1].target)
    counts = reports.counts_by_type(spark, specs, datetime(2024, 1, 1, 1)).collect()
    assert {r.schema_name: r.cnt for r in counts} == {"Event": 1, "Notification": 0}


def test_alert_threshold(spark, sf, folder):
    spec = sample_registry(folder, f"{folder}/c")[0]
    settings = ingest.IngestSettings(f"{folder}/rejects", failed_at=lambda: F.lit(datetime(2024, 1, 1)).cast("timestamp"))
    ingest.ingest_batch(fixtures.faulty_records(fixtures.events(spark, sf)), spec, settings)
    rejects = tables.read(spark, tables.REJECTS, settings.rejects)
    loud = reports.rejects_by_reason(rejects, at_least=100).collect()
    assert {(r.schema_name, r.reason): r.cnt for r in loud} == {
        (None, "missing_schema"): 150, ("Event", "missing_version"): 150, ("Event", "deserialize_error"): 100,
    }


def test_replayed_events_fit_the_event_table(spark, sf, folder):
    spec = sample_registry(folder, f"{folder}/c")[0]
    settings = ingest.IngestSettings(f"{folder}/rejects")
    ingest.ingest_batch(fixtures.faulty_records(fixtures.events(spark, sf)), spec, settings)
    rejects, only = tables.read(spark, tables.REJECTS, settings.rejects), ["unsupported_version"]
    assert reports.replayed_events(reports.replay(rejects, spec, reasons=only)).count() == 0
    again = reports.replay(rejects, spec, reasons=only, accepted=only)
    tables.append(reports.replayed_events(again), spec.target, tables.EVENTS)
    assert tables.read(spark, tables.EVENTS, spec.target).count() == 350 + 50


def test_catalog_targets_are_refused_where_only_folders_work(spark, sf, folder):
    rows = spark.createDataFrame([], tables.EVENTS.columns)
    with pytest.raises(ValueError):
        tables.append(rows, "cat.db.t", tables.EVENTS, batch=("q", 0))
    with pytest.raises(ValueError):
        rewrite.delete_where(spark, "cat.db.t", tables.EVENTS, F.lit(True))


def test_broker_options():
    spec = sample_registry("/t", "/c")[0]
    source = records.BrokerRecords("host:9092", "latest", records_per_task=1000, offsets_per_trigger=10**6)
    assert source.options(spec) == {
        "kafka.bootstrap.servers": "host:9092",
        "subscribe": "sample-events-event",
        "startingOffsets": "latest",
        "includeHeaders": "true",
        "maxRecordsPerPartition": "1000",
        "maxOffsetsPerTrigger": "1000000",
    }
    with pytest.raises(ValueError):
        records.BrokerRecords("h", "yesterday")


def test_required_columns_are_enforced_at_write(spark, folder):
    rows = spark.createDataFrame([(1, None, "Event", b"x")], "id bigint, datetime timestamp, schema_name string, rawdata binary")
    with pytest.raises(Exception, match="datetime is required"):
        tables.append(rows, f"{folder}/events", tables.EVENTS)


def test_field_ids_are_stored(spark, folder):
    import pyarrow.parquet as pq

    tables.append(event_rows(spark, [(1, datetime(2024, 1, 1), "Event", b"x")]), f"{folder}/events", tables.EVENTS)
    [path] = tables.read(spark, tables.EVENTS, f"{folder}/events").inputFiles()
    schema = pq.read_schema(path.removeprefix("file://"))
    ids = {n: int(schema.field(n).metadata[b"PARQUET:field_id"]) for n in schema.names}
    # The schema name is a folder name and not in the file.
    assert ids == {"id": 1, "datetime": 2, "rawdata": 4}
