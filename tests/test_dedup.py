"""Offset intervals and the deliveries they let through."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import dedup
from tidewire.plans import tables
from tidewire.registry import EVENT_TOPIC, StreamSpec
from tidewire.sources import fixtures, records
from tidewire.streaming import ingest
from tidewire.streaming.once import write_once
from conftest import plan_of


def offsets_of(spark, found):
    data = sorted(("t", p, o) for p, os in found.items() for o in os)
    return spark.createDataFrame(data, "topic string, partition int, offset long").repartition(3)


def runs(offsets):
    out = []
    for o in sorted(offsets):
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return [tuple(r) for r in out]


def intervals(df):
    got = {}
    for r in df.orderBy("partition", "low").collect():
        got.setdefault(r["partition"], []).append((r["low"], r["high"]))
    return got


@pytest.mark.parametrize("seed", range(4))
def test_intervals_and_lookups_against_sets(spark, seed, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", [4, 1024, 7, 64][seed])
    pick = random.Random(seed)
    held = {0: set(), 1: {0, 1, 2, 5000}, 2: set(range(900, 2100))}
    state = dedup.merged(dedup.offset_runs(offsets_of(spark, held)))
    for _ in range(3):
        starts = {p: [pick.randrange(6000) for _ in range(12)] for p in (0, 1, 2, 3)}
        more = {p: {o for b in bs for o in range(b, b + pick.choice([1, 1, 2, 40, 900]))} for p, bs in starts.items()}
        fresh = dedup.not_in(offsets_of(spark, more).unionAll(offsets_of(spark, more)), state)
        expected = {(p, o) for p, os in more.items() for o in os if o not in held.get(p, ())}
        got = [(r["partition"], r["offset"]) for r in fresh.collect()]
        assert len(got) == len(expected) and set(got) == expected
        state = dedup.merged(state.unionAll(dedup.offset_runs(fresh)))
        held = {p: held.get(p, set()) | more.get(p, set()) for p in {*held, *more}}
        assert intervals(state) == {p: runs(os) for p, os in held.items() if os}
        state = spark.createDataFrame(state.collect(), dedup.INTERVALS)


def test_lookups_need_no_range_join(spark):
    offsets = spark.createDataFrame([("t", 0, 1)], "topic string, partition int, offset long")
    found = dedup.not_in(offsets, spark.createDataFrame([("t", 0, 0, 9)], dedup.INTERVALS))
    plan = plan_of(found)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def sent(spark, *offsets, partition=0):
    rows = [(b"k", f"{o}".encode(), None, "t", partition, o, None) for o in offsets]
    return spark.createDataFrame(rows, records.RECORD_SCHEMA)


def values(df):
    return sorted(int(bytes(r["value"])) for r in df.collect())


def test_no_first_delivery_is_lost_and_no_repeat_passes(spark, folder):
    ledger = dedup.OffsetLedger(f"{folder}/ledger")
    assert values(ledger.take(sent(spark, 5, 6, 6, 7), 0)) == [5, 6, 7]
    assert values(ledger.take(sent(spark, 7, 8, 1, 5), 1)) == [1, 8]
    # The micro-batch runs again: it gets the same records.
    assert values(ledger.take(sent(spark, 7, 8, 1, 5), 1)) == [1, 8]
    # Late first deliveries between old ones, and repeats of the very first.
    assert values(ledger.take(sent(spark, 2, 3, 4, 5, 0), 2)) == [0, 2, 3, 4]
    assert intervals(ledger.delivered(spark)) == {0: [(0, 8)]}
    assert values(ledger.take(sent(spark, 0, 8, partition=1), 3)) == [0, 8]
    assert intervals(ledger.delivered(spark)) == {0: [(0, 8)], 1: [(0, 0), (8, 8)]}
    assert len(ledger._runs(spark)) == 2


def test_a_table_that_was_not_finished_does_not_count(spark, folder):
    ledger = dedup.OffsetLedger(f"{folder}/ledger")
    ledger.take(sent(spark, 1, 2), 0)
    sent(spark, 1).select("topic", "partition", F.lit(0).alias("low"), F.lit(99).alias("high")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{folder}/ledger/batch=1")
    assert values(ledger.take(sent(spark, 2, 3), 1)) == [3]


def test_the_ledger_grows_with_gaps_only(spark, folder):
    ledger = dedup.OffsetLedger(f"{folder}/ledger")
    for n in range(3):
        rows = spark.range(n * 5000, n * 5000 + 5000).where("id % 2500 <> 1300").select(
            F.lit(b"k").alias("key"), F.lit(b"1").alias("value"), F.lit(None).cast(records.HEADERS_TYPE).alias("headers"),
            F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.current_timestamp().alias("timestamp"),
        )
        assert ledger.take(rows, n).count() == 4998
    assert ledger.delivered(spark).count() == 7


def test_records_without_coordinates_pass_and_their_columns_are_asked_for(spark, folder):
    ledger = dedup.OffsetLedger(f"{folder}/ledger")
    odd = spark.createDataFrame([(b"k", b"1", None, "t", None, 3, None), (b"k", b"2", None, None, 0, 3, None)], records.RECORD_SCHEMA)
    assert values(ledger.take(odd.unionAll(odd), 0)) == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        ledger.take(odd.drop("offset"), 1)


def test_stream_is_written_once_over_restarts(spark, sf, folder):
    rows = fixtures.faulty_records(fixtures.events(spark, sf))
    source, ledger = records.FolderRecords(f"{folder}/r", files_per_trigger=1), dedup.OffsetLedger(f"{folder}/ledger")
    spec = StreamSpec("Event", EVENT_TOPIC, "-", "-")
    for _ in range(2):
        records.write_folder(rows.unionAll(rows).coalesce(2), source.root)
        write_once(source.stream(spark, spec), f"{folder}/out", ledger, f"{folder}/c")
    got = spark.read.parquet(f"{folder}/out")
    assert got.count() == rows.count() == got.select("partition", "offset").distinct().count()


def test_ingest_job_with_a_ledger(spark, sf, folder):
    rows = fixtures.faulty_records(fixtures.events(spark, sf))
    spec = StreamSpec("Event", EVENT_TOPIC, f"{folder}/t", f"{folder}/c")
    settings = ingest.IngestSettings(f"{folder}/d", idempotent=True, rebalance=True, ledger=f"{folder}/ledger")
    for _ in range(2):
        records.write_folder(rows.coalesce(2), f"{folder}/r")
        ingest.run(spark, [spec], records.FolderRecords(f"{folder}/r"), settings)
    delivered = tables.read(spark, tables.EVENTS, spec.target).count() + tables.read(spark, tables.REJECTS, f"{folder}/d").count()
    assert delivered == rows.count()
    with pytest.raises(ValueError, match="idempotent"):
        ingest.IngestSettings(f"{folder}/d", ledger=f"{folder}/ledger")
