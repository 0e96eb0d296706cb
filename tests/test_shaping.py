import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.operators import logs, naming, relabel
from tidewire.sources import fixtures, paths
from tidewire.sources import logs as log_source
from tidewire.streaming import logs as log_job
from tidewire.streaming import metrics as metric_job

LINES = "path string, stream string, line_no bigint, block bigint, ts timestamp, partial boolean, log string"


def joined_by_hand(rows):
    out, open_text = [], {}
    for path, stream, line, _, _, partial, log in sorted(rows, key=lambda r: (r[0], r[2])):
        first, text = open_text.pop((path, stream), (line, ""))
        if partial:
            open_text[path, stream] = (first, text + log)
        else:
            out.append((path, stream, first, text + log, True))
    out += [(path, stream, first, text, False) for (path, stream), (first, text) in open_text.items()]
    return sorted(out)


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_partial_lines_are_joined_across_chunks(spark, size):
    rows = []
    for seed in range(12):
        rng = random.Random(seed)
        share = rng.choice([0.1, 0.5, 0.95])
        rows += [
            (f"f{seed}-{rng.randrange(2)}", rng.choice(["stdout", "stderr"]), n, n // size, None, rng.random() < share, f"{n},")
            for n in range(120)
        ]
    joined = logs.join_partials(spark.createDataFrame(rows, LINES))
    got = sorted((r.path, r.stream, r.line_no, r.log, r.complete) for r in joined.collect())
    assert got == joined_by_hand(rows)


@pytest.mark.parametrize("size, fan", [(1, 1), (1, 2), (3, 1), (10, 10)])
def test_partial_lines_are_joined_over_levels_of_chunks(spark, size, fan, monkeypatch):
    monkeypatch.setattr(logs, "FAN_SHIFT", fan)
    rows = []
    for seed in range(12):
        rng = random.Random(seed)
        share = rng.choice([0.1, 0.5, 0.95, 1.0])
        rows += [
            (f"f{seed}", rng.choice(["stdout", "stderr"]), n, n // size, None, rng.random() < share, f"{n},") for n in range(120)
        ]
    joined = logs.join_partials(spark.createDataFrame(rows, LINES), F.col("block")).collect()
    assert sorted((r.path, r.stream, r.line_no, r.log, r.complete) for r in joined) == joined_by_hand(rows)
    assert {r.part for r in joined} == {0}


@pytest.mark.parametrize("part_bytes", [1, 7, 40])
def test_long_messages_have_numbered_parts(spark, part_bytes):
    rng = random.Random(part_bytes)
    rows = [("f", rng.choice(["stdout", "stderr"]), n, n // 4, None, rng.random() < 0.9, "x" * rng.randrange(6) + f"{n},") for n in range(200)]
    joined = logs.join_partials(spark.createDataFrame(rows, LINES), F.col("block"), part_bytes).collect()
    messages = {}
    for r in sorted(joined, key=lambda r: (r.stream, r.line_no, r.part)):
        parts = messages.setdefault((r.path, r.stream, r.line_no), [])
        assert not any(done for _, done, _ in parts)  # only the last row is complete
        parts.append((r.log, r.complete, r.part))
        # A row holds pieces that begin within its bytes: at most those and one piece more.
        assert len(r.log) < part_bytes + 9
    together = sorted((*k, "".join(t for t, _, _ in v), v[-1][1]) for k, v in messages.items())
    assert together == joined_by_hand(rows)


def test_one_message_over_ten_thousand_chunks(spark):
    n = 10_000
    lines = spark.range(n).select(
        F.lit("f").alias("path"), F.lit("stdout").alias("stream"), F.col("id").alias("line_no"), F.col("id").alias("block"),
        F.lit(None).cast("timestamp").alias("ts"), (F.col("id") < n - 1).alias("partial"), F.lpad(F.col("id").cast("string"), 5, "0").alias("log"),
    )
    joined = logs.join_partials(lines, F.col("block"), part_bytes=5000)
    got = sorted((r.part, r.line_no, r.log, r.complete) for r in joined.collect())
    assert [(p, s, c) for p, s, _, c in got] == [(p, 0, p == 9) for p in range(10)]
    assert "".join(t for _, _, t, _ in got) == "".join(f"{k:05d}" for k in range(n))
    # No window takes a whole file in order: each goes over a chunk, a run of it, or a group of chunks.
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    for spec in re.findall(r"windowspecdefinition\(([^)]*)\)", plan):
        assert "chunk" in spec or "group" in spec


def test_lines_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        made.add(1)
        return f"{n},"

    rng = random.Random(1)
    rows = [("f", rng.choice(["stdout", "stderr"]), n, n // 7, None, rng.random() < 0.6, None) for n in range(300)]
    lines = spark.createDataFrame(rows, LINES).withColumn("log", text("line_no"))
    joined = logs.join_partials(lines, F.col("block"), part_bytes=9).collect()
    assert made.value == 300
    texts = {}
    for r in sorted(joined, key=lambda r: (r.stream, r.line_no, r.part)):
        first, text_so_far, _ = texts.get((r.stream, r.line_no), (r.line_no, "", None))
        texts[r.stream, r.line_no] = (first, text_so_far + r.log, r.complete)
    written = [(*row[:6], f"{row[2]},") for row in rows]
    assert sorted(("f", stream, *t) for (stream, _), t in texts.items()) == joined_by_hand(written)


def test_chunks_of_line_numbers(spark):
    rows = [("f", "stdout", n, 0, None, n % 3 != 2, str(n)) for n in range(9)]
    lines = spark.createDataFrame(rows, LINES).drop("block")
    got = logs.join_partials(lines, F.floor(F.col("line_no") / 2)).orderBy("line_no").collect()
    assert [r.log for r in got] == ["012", "345", "678"]


def test_only_json_objects_are_merged(spark):
    texts = ['{"a":1,"b":{"c":2}}', "{}", "[1]", '"x"', "plain", '{"a":', '{"a":1} x', '{"a":1},{"b":2}', "1],[2", None]
    texts += ['{"a":1}] x', '{"a":1}],[{"b":2}', '{"a":1}} x', '{"a":1},"w":{"b":2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, log string")
    out = logs.merge_json(df).orderBy("i").collect()
    assert [r.fields for r in out[:2]] == [{"a": "1", "b": '{"c":2}'}, {}]
    assert [r.log for r in out[:2]] == [None, None]
    assert [r.log for r in out[2:]] == texts[2:] and all(r.fields is None for r in out[2:])


def test_pod_metadata_does_not_repeat_lines(spark, sf):
    events = fixtures.events(spark, sf)
    lines = fixtures.log_lines(events)
    rich = logs.with_pod(lines, fixtures.pods(events))
    assert rich.count() == lines.count()
    assert rich.where("app IS NULL").select("pod_name").distinct().collect()[0][0] == "web-6"


def test_log_streams_are_split_by_pod(spark, sf, folder):
    events = fixtures.events(spark, sf)
    log_source.write_streams(logs.with_pod(fixtures.log_lines(events), fixtures.pods(events)), folder, "from-")
    back = spark.read.parquet(folder)
    assert back.count() == events.count()
    assert back.where(~F.col("log_stream").startswith("from-web-")).count() == 0


def test_new_log_files_are_read_once(spark, folder):
    def put(name, *lines):
        with open(f"{folder}/in/{name}", "w") as f:
            f.write("".join(f"2024-01-01T00:00:00Z stdout {flag} {text}\n" for flag, text in lines))

    os.makedirs(f"{folder}/in")
    args = (spark, f"{folder}/in", f"{folder}/out", f"{folder}/cp")
    put("a.log", ("P", "1"), ("P", "2"), ("F", "3"), ("F", "4"))
    log_source.collect_new(*args)
    log_source.collect_new(*args)
    put("b.log", ("F", "5"))
    log_source.collect_new(*args)
    lines = spark.read.parquet(f"{folder}/out")
    assert sorted(r.log for r in lines.collect()) == list("12345")
    assert sorted(r.log for r in logs.join_partials(lines).collect()) == ["123", "4", "5"]
    assert sorted(r.log for r in logs.join_partials(log_source.read(spark, f"{folder}/in")).collect()) == ["123", "4", "5"]


def _log_run(spark, folder):
    pods = spark.createDataFrame([("ns", "p", "n1")], "namespace string, pod_name string, node_name string")
    return log_job.collect(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", pods)


def _log_texts(spark, folder):
    return sorted((r.log, r.node_name, r.complete) for r in spark.read.parquet(f"{folder}/out").collect())


def test_growing_log_files_give_each_message_once(spark, folder):
    name = f"p_ns_main-{'0' * 64}.log"
    os.makedirs(f"{folder}/in")

    def put(mode, text, file=name, date=None):
        with open(f"{folder}/in/{file}", mode) as f:
            f.write(text)
        if date:
            os.utime(f"{folder}/in/{file}", (date, date))

    line = "2024-01-01T00:00:0{}Z stdout {} {}\n".format
    put("w", line(1, "F", "é one") + line(2, "P", "tw") + "2024-01-01T00:00:02Z std")
    assert _log_run(spark, folder) == 0
    assert _log_texts(spark, folder) == [("é one", "n1", True)]
    # The unfinished line and the open message go on; an old-dated file appears; another has no known form.
    put("a", "out F o\n\n" + line(4, "P", "th"))
    put("w", line(5, "F", "old"), "other.log", date=1)
    assert _log_run(spark, folder) == 1
    assert _log_texts(spark, folder) == [("", "n1", True), ("old", None, True), ("two", "n1", True), ("é one", "n1", True)]
    assert _log_run(spark, folder) is None
    # The file begins anew: what was open ends there.
    put("w", line(6, "F", "new"))
    assert _log_run(spark, folder) == 2
    assert [t for t in _log_texts(spark, folder) if t[0] in ("th", "new")] == [("new", "n1", True), ("th", "n1", False)]


def test_broken_off_log_run_is_done_again(spark, folder, monkeypatch):
    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/a.log", "w") as f:
        f.write("2024-01-01T00:00:00Z stdout F one\n")
    _log_run(spark, folder)
    with open(f"{folder}/in/a.log", "a") as f:
        f.write("2024-01-01T00:00:00Z stdout F two\n")

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(log_job.paths, "make_dir", fail)
        with pytest.raises(RuntimeError):
            _log_run(spark, folder)
    assert log_job.last_run(spark, f"{folder}/state") == 0
    assert _log_run(spark, folder) == 1
    assert [t[0] for t in _log_texts(spark, folder)] == ["one", "two"]


def test_places_of_lines_in_files_of_many_splits(spark, folder):
    rng = random.Random(3)
    lines = [str(i) + "x" * rng.randrange(300) for i in range(2000)]
    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/a.log", "w") as f:
        f.write("\n".join(lines))
    before = spark.createDataFrame([], "path string, position long")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        found, positions = log_source.appended(spark, f"{folder}/in", before)
        got = [r.value for r in found.orderBy("line_no").collect()]
        assert positions.collect()[0].position == sum(len(t) + 1 for t in lines[:-1])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == lines[:-1]


def counting(log):
    """Opens files and notes how many bytes are read of each."""
    opener = log_source.open_uri

    class File:
        def __init__(self, uri):
            self.file, self.name = opener(uri), uri.rsplit("/", 1)[-1]

        def read_at(self, length, at):
            data = self.file.read_at(length, at)
            with open(log, "a") as out:
                out.write(f"{self.name} {at} {len(data)}\n")
            return data

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    return lambda uri: File(uri)


def test_appended_bytes_are_read_once_whatever_a_file_is_called(spark, folder):
    root, log = f"{folder}/in", f"{folder}/reads"
    os.makedirs(root)

    def put(name, text, mode="a"):
        with open(f"{root}/{name}", mode) as f:
            f.write(text)

    state = {"before": spark.createDataFrame([], log_source.POSITIONS)}

    def run():
        open(log, "w").close()
        found = log_source.appended(spark, root, state["before"], opener=counting(log), range_bytes=500)
        if found is None:
            return None, {}
        lines, positions = found
        rows = [(r.path.rsplit("/", 1)[-1], r.line_no, r.value) for r in lines.collect()]
        kept = positions.collect()
        state["before"] = spark.createDataFrame(kept, log_source.POSITIONS)
        names = {r.path.rsplit("/", 1)[-1]: (r.position, r.was and r.was.rsplit("/", 1)[-1]) for r in kept}
        return sorted(rows), names

    def read(name):
        """Bytes read of a file, but for its head."""
        done = [tuple(map(int, x.split()[1:])) for x in open(log) if x.split()[0] == name]
        done.remove((0, min(log_source.HEAD_BYTES, os.path.getsize(f"{root}/{name}"))))
        return sum(n for _, n in done)

    body = [f"{n:04d} é{'x' * (n % 37)}" for n in range(300)]

    def text(low, high):
        return "".join(t + "\n" for t in body[low:high])

    put("a.log", text(0, 100) + body[100][:7])
    put("b.log", text(0, 3))
    rows, names = run()
    assert [v for f, _, v in rows if f == "a.log"] == body[:100]
    assert names == {"a.log": (len(text(0, 100).encode()), None), "b.log": (len(text(0, 3).encode()), None)}
    assert run()[0] == []  # the unfinished line is no line yet
    # Growth: only what is new is read; ranges look one byte back, and read a last line on to its end.
    put("a.log", body[100][7:] + "\n" + text(101, 105))
    rows, _ = run()
    assert [v for _, _, v in rows] == body[100:105] and read("a.log") == len(text(100, 105).encode())
    # Renamed and grown, and another file under the old name, larger than what was read of the old one.
    os.rename(f"{root}/a.log", f"{root}/a-1.log")
    put("a-1.log", text(105, 110))
    put("a.log", text(150, 300))
    rows, names = run()
    assert [v for f, _, v in rows if f == "a-1.log"] == body[105:110] and read("a-1.log") == len(text(105, 110).encode())
    assert [v for f, _, v in rows if f == "a.log"] == body[150:300]
    assert names["a-1.log"][1] == "a.log" and names["a.log"][1] is None and names["b.log"][1] == "b.log"
    # Copied away and cut off: the copy goes on, the file begins anew.
    put("a-2.log", text(150, 300), "w")
    put("a.log", text(7, 9), "w")
    rows, names = run()
    assert rows == [("a.log", 0, body[7]), ("a.log", len(text(7, 8).encode()), body[8])]
    assert names["a-2.log"] == (len(text(150, 300).encode()), "a.log") and names["a.log"][1] is None


def test_ranges_of_lines(tmp_path):
    rng = random.Random(8)
    for _ in range(200):
        lines = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(rng.randrange(1, 12))]
        data = b"\n".join(lines) + rng.choice([b"", b"\n"])

        class File:
            def read_at(self, length, at):
                return data[at : at + length]

        start = 0 if rng.random() < 0.5 else data.find(b"\n") + 1
        step = rng.choice([1, 3, 10, 1000])
        got = []
        for low in range(start, len(data), step):
            at, found = log_source.whole_lines(File(), start, low, min(low + step, len(data)), len(data), step=rng.choice([1, 4, 100]))
            assert data[at : at + len(found)] == found
            got.append(found)
        assert b"".join(got) == data[start : data.rfind(b"\n") + 1]


def test_open_messages_follow_a_renamed_file(spark, folder):
    os.makedirs(f"{folder}/in")
    name = f"p_ns_main-{'0' * 64}.log"
    line = "2024-01-01T00:00:0{}Z stdout {} {}\n".format
    with open(f"{folder}/in/{name}", "w") as f:
        f.write(line(1, "F", "one") + line(2, "P", "tw"))
    _log_run(spark, folder)
    os.rename(f"{folder}/in/{name}", f"{folder}/in/q{name}")
    with open(f"{folder}/in/q{name}", "a") as f:
        f.write(line(3, "F", "o"))
    with open(f"{folder}/in/{name}", "w") as f:
        f.write(line(4, "F", "another file"))
    _log_run(spark, folder)
    assert [t[0] for t in _log_texts(spark, folder)] == ["another file", "one", "two"]
    assert all(done for *_, done in _log_texts(spark, folder))


def test_target_labels_come_before_those_of_beans(spark):
    labels = {"__meta_kubernetes_pod_label_strimzi_io_kind": "Kafka", "topic": "t"}
    bean = "kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec, topic=a><>Count"
    df = spark.sql("SELECT timestamp'2024-01-01' AS ts, 1.0D AS value").withColumns(
        {"bean": F.lit(bean), "labels": F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])}
    )
    assert metric_job.sampled(df).collect()[0].labels == {"exported_topic": "a", "topic": "t", "strimzi_io_kind": "Kafka"}
    other = df.withColumn("labels", F.create_map(F.lit("__meta_kubernetes_pod_label_strimzi_io_kind"), F.lit("Pod")))
    assert metric_job.sampled(other).count() == 0


def test_targets_are_relabelled_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    row_by_row = relabel.relabel_pods

    @F.udf("map<string,string>")
    def counted(labels):
        made.add(1)
        return labels

    def relabelled(df, **settings):
        return row_by_row(df.withColumn("labels", counted("labels")), **settings)

    kind = "__meta_kubernetes_pod_label_strimzi_io_kind"
    held = [
        {kind: "Kafka", "__meta_kubernetes_pod_name": "a", "x": "1"}, {"x": "1", kind: "Kafka", "__meta_kubernetes_pod_name": "a"},
        {kind: "KafkaConnect", "x": None}, {kind: "KafkaConnect", "y": None}, {kind: "Pod"}, {kind: None}, {}, None,
    ]
    bean = "kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec, topic=a><>Count"
    rows = [(bean, held[n % len(held)], n, float(n)) for n in range(400)]
    df = spark.createDataFrame(rows, "bean string, labels map<string,string>, n long, value double")
    df = df.withColumn("ts", F.timestamp_seconds("n")).drop("n")
    plain = row_by_row(df, drop_meta=True).where(F.col("labels")["strimzi_io_kind"].isin("Kafka", "KafkaConnect")).collect()
    expected = sorted((r.value, sorted({"topic": "a", **r.labels}.items(), key=str)) for r in plain)
    monkeypatch.setattr(relabel, "relabel_pods", relabelled)
    got = metric_job.sampled(df).collect()
    assert sorted((r.value, sorted(r.labels.items(), key=str)) for r in got) == expected and len(got) == 200
    # Once for each distinct map, in every place where the plan makes use of them.
    assert 0 < made.value < 100


BEANS = [
    ("java.lang<type=Memory><HeapMemoryUsage>used", "jvm_memory_bytes_used", {"area": "heap"}, "GAUGE"),
    ("java.lang<type=Memory><NonHeapMemoryUsage>max", "jvm_memory_bytes_max", {"area": "nonheap"}, "GAUGE"),
    ("java.lang<type=MemoryPool, name=G1 Old Gen><Usage>used", "jvm_memory_pool_bytes_used", {"pool": "G1 Old Gen"}, "GAUGE"),
    ("java.lang<type=GarbageCollector, name=G1 Young><>CollectionCount", "jvm_gc_collection_seconds_count", {"gc": "G1 Young"}, "COUNTER"),
    ("java.lang<type=GarbageCollector, name=G1 Young><>CollectionTime", "jvm_gc_collection_seconds_sum", {"gc": "G1 Young"}, "COUNTER"),
    ("java.lang<type=Threading><>ThreadCount", "jvm_threads_threadcount", {}, "GAUGE"),
    ("java.lang<type=ClassLoading><>LoadedClassCount", "jvm_classes_loadedclasscount", {}, "GAUGE"),
    (
        "kafka.server<type=FetcherLagMetrics, name=ConsumerLag, clientId=c, topic=t, partition=0><>Value",
        "kafka_server_fetcherlagmetrics_consumerlag", {"clientId": "c", "topic": "t", "partition": "0"}, "GAUGE",
    ),
    (
        # An empty label value leaves the label out.
        "kafka.server<type=FetcherLagMetrics, name=ConsumerLag, clientId=c, topic=t, partition=><>Value",
        "kafka_server_fetcherlagmetrics_consumerlag", {"clientId": "c", "topic": "t"}, "GAUGE",
    ),
    (
        "kafka.server<type=F, name=N, clientId=c, brokerHost=h, brokerPort=1><>Value",
        "kafka_server_f_n", {"clientId": "c", "broker": "h:1"}, "GAUGE",
    ),
    (
        "kafka.server<type=socket-server-metrics, cipher=AES, protocol=TLS, listener=L, networkProcessor=1><>connections",
        "kafka_server_socket_server_metrics_connections_tls_info",
        {"cipher": "AES", "protocol": "TLS", "listener": "L", "networkProcessor": "1"}, "GAUGE",
    ),
    (
        "kafka.server<type=s, clientSoftwareName=a, clientSoftwareVersion=2, listener=L, networkProcessor=1><>connections",
        "kafka_server_s_connections_software",
        {"clientSoftwareName": "a", "clientSoftwareVersion": "2", "listener": "L", "networkProcessor": "1"}, "GAUGE",
    ),
    (
        "kafka.server<type=s, listener=L, networkProcessor=1><>connection-count",
        "kafka_server_s_connection_count", {"listener": "L", "networkProcessor": "1"}, "GAUGE",
    ),
    ("kafka.server<type=Pool, name=AvgIdlePercent><>MeanRate", "kafka_server_pool_avgidle_percent", {}, "GAUGE"),
    ("kafka.network<type=S, name=AvgIdlePercent><>Value", "kafka_network_s_avgidle_percent", {}, "GAUGE"),
    ("kafka.network<type=P, name=IdlePercent, networkProcessor=2><>Value", "kafka_network_p_idle_percent", {"networkProcessor": "2"}, "GAUGE"),
    (
        "kafka.network<type=R, name=RequestsPerSec, request=Fetch, version=1><>Count",
        "kafka_network_r_requests_total", {"request": "Fetch", "version": "1"}, "COUNTER",
    ),
    ("kafka.server<type=B, name=BytesInPerSec, topic=t><>Count", "kafka_server_b_bytesin_total", {"topic": "t"}, "COUNTER"),
    # Also fits the plain count rule, which comes later.
    ("kafka.server<type=B, name=BytesInPerSec><>Count", "kafka_server_b_bytesin_total", {}, "COUNTER"),
    ("kafka.cluster<type=P, name=U, topic=t, partition=0><>Value", "kafka_cluster_p_u", {"topic": "t", "partition": "0"}, "GAUGE"),
    ("kafka.server<type=D, name=Size, op=x><>Value", "kafka_server_d_size", {"op": "x"}, "GAUGE"),
    ("kafka.server<type=ReplicaManager, name=LeaderCount><>Value", "kafka_server_replicamanager_leadercount", {}, "GAUGE"),
    ("kafka.network<type=R, name=T, request=F, version=1><>Count", "kafka_network_r_t_count", {"request": "F", "version": "1"}, "COUNTER"),
    (
        "kafka.network<type=R, name=T, request=F, version=1><>99thPercentile",
        "kafka_network_r_t", {"request": "F", "version": "1", "quantile": "0.99"}, "GAUGE",
    ),
    ("kafka.network<type=R, name=T, request=F><>Count", "kafka_network_r_t_count", {"request": "F"}, "COUNTER"),
    ("kafka.network<type=R, name=T, request=F><>95thPercentile", "kafka_network_r_t", {"request": "F", "quantile": "0.95"}, "GAUGE"),
    ("kafka.log<type=L, name=F><>Count", "kafka_log_l_f_count", {}, "COUNTER"),
    ("kafka.log<type=L, name=F><>999thPercentile", "kafka_log_l_f", {"quantile": "0.999"}, "GAUGE"),
    ("kafka.cruisecontrol<name=LoadMonitor.x><>Value", "kafka_cruisecontrol_loadmonitor_x_value", {}, "GAUGE"),
    ("kafka.utils<type=Throttler><>Other", None, None, None),
    ("other", None, None, None),
]


@pytest.fixture(scope="module")
def named(spark):
    rules = (*naming.BROKER_RULES, *naming.REBALANCER_RULES)
    beans = spark.createDataFrame([(b[0], 1.0) for b in BEANS], "bean string, value double")
    return {r.bean: r for r in naming.normalize(beans, rules).collect()}


@pytest.mark.parametrize("bean, metric, labels, kind", BEANS)
def test_naming_rules(named, bean, metric, labels, kind):
    row = named.get(bean)
    assert (row and (row.metric, row.labels, row.kind)) == (metric and (metric, labels, kind))


def test_naming_row_by_row_is_the_same(spark, named):
    rules = (*naming.BROKER_RULES, *naming.REBALANCER_RULES)
    rows = spark.createDataFrame([(b[0] + ": 1.0",) for b in BEANS], "bean string")
    got = {r.bean.removesuffix(": 1.0"): (r.metric, r.labels, r.kind) for r in naming.name_rows(rows, rules).collect()}
    assert got == {b: (r.metric, r.labels, r.kind) for b, r in named.items()}


def test_first_rule_wins(spark):
    rules = [naming.Rule("a(.)", "first_$1"), naming.Rule("(..)", "Second_$1", "COUNTER", {"$1": "x"})]
    rows = spark.createDataFrame([("ab",), ("bc",), ("c",)], "bean string")
    got = sorted((r.bean, r.metric, r.labels, r.kind) for r in naming.name_rows(rows, rules).collect())
    assert got == [("ab", "first_b", {}, "GAUGE"), ("bc", "second_bc", {"bc": "x"}, "COUNTER")]


def test_rule_count():
    assert len(naming.BROKER_RULES) == 28 and len(naming.REBALANCER_RULES) == 1


def test_container_files_are_few(spark, folder):
    rows = spark.range(30_000).select(F.col("id").alias("event_id"), F.lit(0).alias("n"), F.lit("a.log").alias("name"), F.lit("x").alias("value"))
    fixtures.write_container_files(rows, folder)
    assert paths.children(spark, folder) == ["range=0"] and paths.children(spark, f"{folder}/range=0") == ["a.log"]
