import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import executed
from tidewire.functions.labels import label, label_text
from tidewire.operators import aggregates, ranges, relabel
from tidewire.plans import panels
from tidewire.plans.queries import CHOSEN, HOURLY, QUERIES, _scrape_grid, _scraped
from tidewire.sources import fixtures, paths, samples

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def sample_frame(spark, series):
    rows = [
        ("m", labels, START + timedelta(seconds=t), float(v)) for labels, points in series for t, v in points
    ]
    return spark.createDataFrame(rows, samples.SAMPLE_SCHEMA)


def expected(points, over, t, width):
    """One window straight from the definition."""
    seen = sorted(p for p in points if t - width < p[0] <= t)
    if not seen:
        return None
    if over == "instant":
        return seen[-1][1]
    if len(seen) < 2:
        return None
    if over == "irate":
        (t1, v1), (t2, v2) = seen[-2:]
        return (v2 if v2 < v1 else v2 - v1) / (t2 - t1)
    change = seen[-1][1] - seen[0][1]
    if over != "delta":
        change += sum(a[1] for a, b in zip(seen, seen[1:]) if b[1] < a[1])
    covered = seen[-1][0] - seen[0][0]
    gap = covered / (len(seen) - 1)
    begin, end = seen[0][0] - (t - width), t - seen[-1][0]
    begin = gap / 2 if begin >= 1.1 * gap else begin
    end = gap / 2 if end >= 1.1 * gap else end
    if over != "delta" and change > 0 and seen[0][1] >= 0:
        begin = min(begin, covered * seen[0][1] / change)
    out = change * (covered + begin + end) / covered
    return out / width if over == "rate" else out


CASES = [
    # step, window, chunk: overlapping, touching and separate windows; one and many chunks.
    (10, 60, None), (60, 60, 120), (90, 60, 100), (7, 50, 21),
]


@pytest.mark.parametrize("over", list(ranges.FUNCTIONS))
@pytest.mark.parametrize("step, width, chunk", CASES)
def test_range_functions_against_the_definition(spark, over, step, width, chunk):
    rng = random.Random(f"{over}{step}{width}")
    series = []
    for n in range(4):
        times = sorted(rng.sample(range(-200, 500), rng.choice([1, 3, 40, 120])))
        value, points = 0.0, []
        for t in times:
            value = rng.uniform(0, 3) if rng.random() < 0.1 else value + rng.uniform(-1 if n == 3 else 0, 9)
            points.append((t, value))
        series.append(({"n": str(n)}, points))
    grid = ranges.Grid(START, START + timedelta(seconds=431), timedelta(seconds=step))
    got = ranges.FUNCTIONS[over](
        sample_frame(spark, series), grid, timedelta(seconds=width), chunk=chunk and timedelta(seconds=chunk)
    )
    found = {(r.n, int(r.t)): r.value for r in got.select(label("n").alias("n"), F.unix_seconds("ts").alias("t"), "value").collect()}
    base = int(START.timestamp())
    want = {}
    for labels, points in series:
        for t in range(0, 432, step):
            value = expected(points, over, t, width)
            if value is not None:
                want[labels["n"], base + t] = value
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


def test_kept_columns_replace_the_labels(spark):
    frame = sample_frame(spark, [({"a": "1", "b": "2"}, [(0, 1), (10, 3)]), ({"a": "1", "b": "3"}, [(0, 5), (10, 6)])])
    grid = ranges.Grid.at(START + timedelta(seconds=10))
    got = ranges.delta(frame, grid, timedelta(seconds=20), keep={"a": label("a")})
    assert got.columns == [*ranges.SERIES, "a", "ts", "value"]
    assert got.select(*ranges.SERIES).distinct().count() == 2
    assert aggregates.sum_by(got, ["a"]).count() == 1


def test_series_do_not_depend_on_label_order(spark):
    frame = spark.sql(
        "SELECT 'm' metric, map('a','1','b','2') labels, timestamp'2024-01-01 00:00:00' ts, 1D value "
        "UNION ALL SELECT 'm', map('b','2','a','1'), timestamp'2024-01-01 00:00:10', 4D"
    )
    got = ranges.delta(frame, ranges.Grid.at(START + timedelta(seconds=10)), timedelta(seconds=20))
    assert got.count() == 1


def test_one_shuffle_and_no_cross_join(spark):
    frame = sample_frame(spark, [({"a": "1"}, [(0, 1), (10, 3)])])
    grid = ranges.Grid(START, START + timedelta(hours=1), timedelta(seconds=15))
    for over, function in ranges.FUNCTIONS.items():
        plan = executed(function(frame, grid, timedelta(minutes=5)))
        assert plan.count("Exchange") == 1, over
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_plain_sum_shuffles_no_labels(spark):
    frame = sample_frame(spark, [({"a": "1"}, [(0, 1), (10, 3)])])
    panel = panels.Panel("d", "t", "m", "sum", over="rate", window=60)
    plan = executed(panels.evaluate(frame, panel, ranges.Grid.at(START)))
    shuffled = plan[plan.index("Exchange hashpartitioning(series_a"):].splitlines()[1]
    assert "labels" not in shuffled.split("[", 1)[1].split(",")[0] and "pairs" not in shuffled


def test_golden_increase(spark):
    counters = fixtures.hourly_counters(fixtures.events(spark, "/root/testdata/sf0.01"))
    row = ranges.increase(counters, HOURLY, timedelta(hours=6)).agg(F.count("*").alias("n"), F.sum("value").alias("s")).first()
    assert row.n == 600 and row.s == pytest.approx(494406.834, abs=1e-3)


def test_grid():
    grid = ranges.Grid.last_hour(datetime(2024, 1, 1, 1), timedelta(minutes=1))
    assert grid.points == 61 and grid.start == datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        ranges.Grid(START, START, timedelta(0))
    with pytest.raises(ValueError):
        ranges.Grid(START, START - timedelta(1), timedelta(1))


def test_panel_catalogue():
    assert len(panels.PANELS) == 67
    assert [len(panels.dashboard(d)) for d in ("exporter", "broker", "operators")] == [16, 33, 18]
    kinds = {}
    for p in panels.PANELS:
        kinds[p.agg, p.over] = kinds.get((p.agg, p.over), 0) + 1
    assert kinds == {
        ("sum", "instant"): 38, ("sum", "irate"): 14, ("sum", "rate"): 6, ("sum", "increase"): 5, ("sum", "delta"): 1,
        ("count", "instant"): 2, ("none", "instant"): 1,
    }


@pytest.mark.parametrize("board", ["exporter", "broker", "operators"])
def test_dashboard_equals_its_panels(spark, sf, board):
    rows = _scraped(spark, sf, board)
    grid = _scrape_grid(spark, sf, 300)
    together = panels.evaluate_all(rows, grid, panels.dashboard(board), CHOSEN).collect()
    for number, panel in panels.dashboard(board)[:: 5]:
        alone = panels.evaluate(rows, panel, grid, CHOSEN)
        text = label_text() if panel.agg == "none" else F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(n)) for n in panel.by])
        one = {(r.labels, r.ts): r.value for r in alone.select(text.alias("labels"), "ts", "value").collect()}
        part = {(r.labels, r.ts): r.value for r in together if r.panel == number}
        assert part.keys() == one.keys() and part
        assert all(part[k] == pytest.approx(one[k]) for k in one)


def test_variables_must_be_chosen(spark, sf):
    with pytest.raises(KeyError):
        panels.evaluate(_scraped(spark, sf, "broker"), panels.PANELS[16], _scrape_grid(spark, sf))


def test_sample_table_prunes_metric_and_day(spark, folder):
    frame = sample_frame(spark, [({"a": "1"}, [(d * 86400, d) for d in range(9)])])
    samples.write(frame.unionByName(frame.withColumn("metric", F.lit("n"))), folder)
    found = samples.scan(samples.read(spark, folder), "m", datetime(2024, 1, 4), datetime(2024, 1, 6), {"a": ["1", "2"]})
    plan = executed(found)
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "metric" in filters and "day" in filters
    assert sorted(r.value for r in found.collect()) == [4.0, 5.0]


def test_metrics_are_read_from_their_folders(spark, folder):
    frame = sample_frame(spark, [({"a": "1"}, [(0, 1), (86400, 2)])])
    samples.write(frame.unionByName(frame.withColumn("metric", F.lit("n"))), folder)
    found = samples.read(spark, folder, ["n", "absent"])
    assert {r.metric for r in found.collect()} == {"n"} and found.columns == samples.read(spark, folder).columns
    assert len(found.inputFiles()) == 2 and all("/metric=n/" in f for f in found.inputFiles())
    none = samples.read(spark, folder, ["absent"])
    assert none.count() == 0 and none.schema == samples.read(spark, folder).schema


def test_scan_without_a_matching_target(spark):
    frame = sample_frame(spark, [({"a": "1"}, [(0, 1)])])
    assert samples.scan(frame, targets={"a": ["2"]}).count() == 0


def test_relabelled_pods(spark, sf):
    row = relabel.relabel_pods(fixtures.pod_targets(fixtures.events(spark, sf)), drop_meta=True).first()
    assert set(row.labels) == {"namespace", "kubernetes_pod_name", "node_name", "node_ip", "strimzi_io_cluster", "strimzi_io_kind"}
    # The label of the same name is overwritten.
    assert row.labels["namespace"] == "kafka"


def test_table_page(spark):
    table = spark.createDataFrame([(i, str(i % 3), i) for i in range(30)], "a int, b string, c int")
    page = aggregates.top_rows(table, 1, 4).collect()
    assert [(r.b, r.a) for r in page] == [("2", 2), ("2", 5), ("2", 8), ("2", 11)]


def test_last_offsets_feed_the_lag_panel(spark, sf):
    rows = QUERIES["consumer_lag"](spark, "/root/testdata/sf0.01").orderBy("partition").collect()
    assert [(r.log_end, r.committed, r.lag) for r in rows] == [(3334, 1667, 1667), (3333, 1667, 1666), (3333, 1666, 1667)]


def test_all_choices_are_those_of_each_variable(spark, sf):
    for board in ("exporter", "broker"):
        rows = _scraped(spark, sf, board)
        got = {tuple(r) for r in panels.all_choices(rows, board, CHOSEN).collect()}
        single = [(v.name, panels.choices(rows, v, CHOSEN)) for v in panels.VARIABLES if v.dashboard == board]
        assert got == {(name, r.value) for name, found in single for r in found.collect()}
        assert executed(panels.all_choices(rows, board, CHOSEN)).count("Scan parquet") == 1


def test_samples_lie_in_chunks(spark, folder):
    rows = [(n, START + timedelta(hours=n), float(n)) for n in range(40)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, value double")
    found = fixtures.scrape_samples(events, "broker", ["a", "b_is_preferred"])
    assert found.count() == 30  # a row for each target and hour, not one for each sample
    samples.write_chunks(found, folder)
    table = samples.of_chunks(samples.read_chunks(spark, folder, ["a", "b_is_preferred"]))
    # Labels are matched and hashed below the place where a chunk becomes samples.
    chosen = executed(table.where(label("partition") == "1").select(*ranges.SERIES, "ts"))
    assert "partition" not in chosen[: chosen.index("Generate")] and "xxhash64" not in chosen[: chosen.index("Generate")]
    got = {(r["metric"], r["ts"], r["labels"]["partition"], r["labels"].get("topic"), r["value"]) for r in table.collect()}
    assert len(got) == 80
    scrape = datetime.fromisoformat(fixtures.SCRAPE_START)
    for n, _, value in rows:
        at, slot = scrape + timedelta(seconds=n // 15 * 15), n % 15
        topic = None if slot % 5 == 4 else f"topic-{slot % 5}"
        assert ("a", at, str(slot // 5), topic, n // 15 * 500 + value) in got
        assert ("b_is_preferred", at, str(slot // 5), topic, float(n % 2)) in got


def test_only_metrics_asked_for_are_written(spark, folder):
    rows = [(n, datetime(2024, 1, 1) + timedelta(hours=n), n, "view", float(n), '{"k": 1}') for n in range(40)]
    kind = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/events.parquet")
    first = _scraped(spark, folder, "broker", ["kafka_log_log_size"])
    root = first.inputFiles()[0].split("/metric=")[0]
    listed = lambda: {n for n in paths.children(spark, root) if n.startswith("metric=")}
    assert listed() == {"metric=kafka_log_log_size"} and first.count() == 40
    both = _scraped(spark, folder, "broker", ["kafka_log_log_size", "jvm_threads"])
    assert listed() == {"metric=kafka_log_log_size", "metric=jvm_threads"} and both.count() == 80
    assert _scraped(spark, folder, "broker", ["jvm_threads"]).count() == 40
