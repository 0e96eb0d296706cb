import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.operators import rewrite
from tidewire.plans import tables
from tidewire.sources import paths
from conftest import executed

E = tables.EVENTS


def rows(spark, *items):
    data = [(i, datetime(2024, 1, day, hour), "Event", text.encode()) for i, day, hour, text in items]
    return spark.createDataFrame(data, E.columns)


def content(spark, target):
    got = tables.read(spark, E, target).collect()
    assert all(r.datetime_day == r.datetime.date() for r in got)
    return sorted((r.id, r.datetime.day, bytes(r.rawdata).decode()) for r in got)


@pytest.fixture(params=[None, ("q", 0)], ids=["plain", "idempotent"])
def table(request, spark, folder):
    target = f"{folder}/events"
    tables.append(rows(spark, (1, 1, 1, "a"), (2, 1, 2, "b"), (3, 2, 3, "c"), (4, 3, 4, "d")), target, E, batch=request.param)
    return target


def test_upsert_replaces_moves_and_adds(spark, table):
    rewrite.upsert(spark, table, E, rows(spark, (2, 2, 0, "moved"), (4, 3, 0, "new"), (9, 5, 0, "added")))
    assert content(spark, table) == [(1, 1, "a"), (2, 2, "moved"), (3, 2, "c"), (4, 3, "new"), (9, 5, "added")]


def test_upsert_twice_is_stable(spark, table):
    for _ in range(2):
        rewrite.upsert(spark, table, E, rows(spark, (2, 2, 0, "moved")))
    assert content(spark, table) == [(1, 1, "a"), (2, 2, "moved"), (3, 2, "c"), (4, 3, "d")]


def test_upsert_can_empty_a_partition(spark, table):
    rewrite.upsert(spark, table, E, rows(spark, (4, 1, 0, "back")))
    assert content(spark, table) == [(1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, 1, "back")]


def test_upsert_refuses_two_changes_of_one_row(spark, table):
    with pytest.raises(ValueError, match="more than one"):
        rewrite.upsert(spark, table, E, rows(spark, (1, 1, 0, "x"), (1, 1, 0, "y")))


def test_delete_of_rows_and_whole_partitions(spark, table):
    rewrite.delete_where(spark, table, E, F.col("id").isin(1, 3))
    assert content(spark, table) == [(2, 1, "b"), (4, 3, "d")]
    rewrite.delete_where(spark, table, E, F.col("id") == 99)
    assert content(spark, table) == [(2, 1, "b"), (4, 3, "d")]


def test_delete_keeps_rows_for_which_the_condition_is_unknown(spark, table):
    rewrite.delete_where(spark, table, E, F.when(F.col("id") == 1, F.lit(True)))
    assert [r[0] for r in content(spark, table)] == [2, 3, 4]


def test_update_moves_rows_into_days_with_other_rows(spark, table):
    rewrite.update_where(
        spark, table, E, F.col("id") <= 2,
        {"datetime": F.col("datetime") + F.expr("interval 1 day"), "rawdata": F.lit("u").cast("binary")},
    )
    assert content(spark, table) == [(1, 2, "u"), (2, 2, "u"), (3, 2, "c"), (4, 3, "d")]


def test_untouched_partitions_keep_their_files(spark, table):
    before = {f for f in tables.read(spark, E, table).inputFiles() if "2024-01-03" in f}
    rewrite.delete_where(spark, table, E, F.col("id") == 1)
    after = {f for f in tables.read(spark, E, table).inputFiles() if "2024-01-03" in f}
    assert before == after and before


def test_one_condition_for_all_partitions_prunes_the_scan(spark, table):
    keys = rewrite._keys(tables.read(spark, E, table), E)
    found = rewrite._partitions(tables.read(spark, E, table).where("id <= 2"), keys)
    kept = tables.read(spark, E, table).where(rewrite._inside(found, keys))
    plan = executed(kept)
    assert "concat_ws" in plan[plan.index("PartitionFilters: [") :] and "Filter (" not in plan
    assert sorted(r.id for r in kept.collect()) == [1, 2]


class Stop(Exception):
    pass


def stopping(real, before):
    def step(*args):
        if not before:
            real(*args)
        raise Stop

    return step


CHANGES = {
    "upsert": lambda spark, t: rewrite.upsert(spark, t, E, rows(spark, (2, 2, 0, "moved"), (4, 1, 0, "back"))),
    "delete": lambda spark, t: rewrite.delete_where(spark, t, E, "id IN (3, 4)"),
    "update": lambda spark, t: rewrite.update_where(spark, t, E, "id = 4", {"datetime": F.col("datetime") - F.expr("interval 1 day")}),
}


# Each change once at each step would say the same many times over.
@pytest.mark.parametrize(
    "change, at",
    [("upsert", "staged"), ("delete", "recorded"), ("upsert", "recorded"), ("delete", "overwritten"), ("update", "dropped"), ("upsert", "forgotten")],
)
@pytest.mark.parametrize("table", [None], indirect=True)
def test_a_change_that_breaks_off_between_two_steps_ends_in_the_same_rows(spark, table, monkeypatch, change, at):
    whole = table + "-whole"
    for f in tables.read(spark, E, table).select("id", "datetime", "schema_name", "rawdata").collect():
        tables.append(spark.createDataFrame([f], E.columns), whole, E)
    before = content(spark, table)
    CHANGES[change](spark, whole)
    expected = content(spark, whole)
    assert expected != before
    with monkeypatch.context() as patch:
        if at == "staged":
            patch.setattr(rewrite, "_record", stopping(rewrite._record, before=True))
        else:
            number = ["recorded", "overwritten", "dropped", "forgotten"].index(at)
            steps = list(rewrite.STEPS)
            steps[number] = stopping(steps[number], before=True)
            patch.setattr(rewrite, "STEPS", tuple(steps))
        with pytest.raises(Stop):
            CHANGES[change](spark, table)
    if at == "staged":
        assert not rewrite.resume(spark, table) and content(spark, table) == before
        CHANGES[change](spark, table)
    else:
        assert rewrite.resume(spark, table) == (at != "forgotten")
    assert content(spark, table) == expected
    assert not rewrite.resume(spark, table)


def test_half_an_overwrite_is_mended_by_the_next_change(spark, table, monkeypatch):
    def half(session, target, intent):
        rewrite.paths.drop_dir(session, f"{target}/schema_name=Event/datetime_day=2024-01-01")
        raise Stop

    with monkeypatch.context() as patch:
        patch.setattr(rewrite, "STEPS", (half,))
        with pytest.raises(Stop):
            rewrite.delete_where(spark, table, E, "id = 2")
    assert [r[0] for r in content(spark, table)] == [3, 4]
    rewrite.delete_where(spark, table, E, "id = 4")
    assert content(spark, table) == [(1, 1, "a"), (3, 2, "c")]


def test_an_intent_that_was_not_finished_does_not_count(spark, table):
    before = content(spark, table)
    spark.createDataFrame([("{",)], "value string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(
        f"{table}/{rewrite.INTENT}"
    )
    assert not rewrite.resume(spark, table) and content(spark, table) == before
    rewrite.delete_where(spark, table, E, "id = 1")
    assert content(spark, table) == before[1:]


def test_partition_values_are_named_as_their_folders(spark, folder):
    odd = ["a b", "x=y", "50%", "q?", "é/ü", "__h", "{z}", "\x01", None]
    df = spark.createDataFrame([(v, n) for n, v in enumerate(odd)], "k string, n int")
    df.write.partitionBy("k").parquet(folder + "/t")
    from os import listdir

    assert {f"k={paths.escaped(chr(0) if v is None else v)}" for v in odd} == {f for f in listdir(folder + "/t") if f.startswith("k=")}


class Catalog:
    """A session that keeps the statements it is given."""

    def __init__(self, spark):
        self.spark, self.said = spark, []

    def sql(self, text):
        self.said.append(text)
        # The statement must be one that Spark can read.
        self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)

    def __getattr__(self, name):
        return getattr(self.spark, name)


def test_statements_for_tables_of_a_catalog(spark, monkeypatch):
    catalog = Catalog(spark)
    monkeypatch.setattr(type(spark.range(1)), "sparkSession", property(lambda self: catalog))
    rewrite.delete_where(catalog, "cat.db.t", E, "id < 3")
    rewrite.update_where(catalog, "cat.db.t", E, "id = 1", {"rawdata": "x'00'", "datetime": "datetime + interval 1 day"})
    rewrite.upsert(catalog, "cat.db.t", E, rows(spark, (1, 1, 1, "a")))
    keyed = rows(spark, (1, 1, 1, "a"), (2, 1, 1, "b")).select("*", F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"))
    counts = tables.append(keyed, "cat.db.t", E, batch=("q", 3), counted={"rows": F.count(F.lit(1))})
    assert counts == {"rows": 2}
    said = [re.sub("rows_[0-9a-f]{32}", "v", s) for s in catalog.said]
    assert said == [
        "DELETE FROM cat.db.t WHERE id < 3",
        "UPDATE cat.db.t SET `rawdata` = x'00', `datetime` = datetime + interval 1 day WHERE id = 1",
        "MERGE INTO cat.db.t AS t USING v AS s ON t.`schema_name` = s.`schema_name` AND t.`id` = s.`id` "
        "WHEN MATCHED THEN UPDATE SET t.`datetime` = s.`datetime`, t.`rawdata` = s.`rawdata` "
        "WHEN NOT MATCHED THEN INSERT (`id`, `datetime`, `schema_name`, `rawdata`) VALUES (s.`id`, s.`datetime`, s.`schema_name`, s.`rawdata`)",
        "MERGE INTO cat.db.t AS t USING v AS s ON t.`topic` = s.`topic` AND t.`partition` = s.`partition` AND t.`offset` = s.`offset` "
        "WHEN NOT MATCHED THEN INSERT (`id`, `datetime`, `schema_name`, `rawdata`, `topic`, `partition`, `offset`) "
        "VALUES (s.`id`, s.`datetime`, s.`schema_name`, s.`rawdata`, s.`topic`, s.`partition`, s.`offset`)",
    ]
    with pytest.raises(ValueError, match="SQL"):
        rewrite.update_where(catalog, "cat.db.t", E, "id = 1", {"rawdata": F.lit(b"x")})


def test_ddl_with_coordinates():
    text = tables.create_sql("cat.db.t", E.with_coordinates())
    assert "topic STRING,\n  partition INT,\n  offset BIGINT\n" in text
    assert E.with_coordinates().with_coordinates() == E.with_coordinates()
