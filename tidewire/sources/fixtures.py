"""Test inputs derived row by row from the ``events`` and ``documents`` tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.headers import build_headers
from tidewire.operators.aggregates import EXACT
from tidewire.operators.naming import bean_text
from tidewire.registry import EVENT_TOPIC, NOTIFICATION_TOPIC, iso_utc
from tidewire.session import work_dir
from tidewire.sources import paths, samples


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Times in the tables have no zone and stand for UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _good_headers(name: str | Column = "Event", version: str = "1") -> Column:
    return build_headers(proto_schema=name, proto_version=version)


def _value(stamp: Column, name: Column) -> Column:
    body = F.struct(F.col("event_id").alias("id"), stamp.alias("datetime"), name.alias("name"))
    return F.to_json(body).cast("binary")


def _record(headers: Column, value: Column, topic: Column) -> list[Column]:
    return [
        F.col("event_id").cast("string").cast("binary").alias("key"),
        value.alias("value"),
        headers.alias("headers"),
        topic.alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        F.expr("event_id div 3").alias("offset"),
        F.col("ts").alias("timestamp"),
    ]


def _with_text_behind(whole: Column, number: Column) -> Column:
    """An object that is cut off, or one with text behind it that closes a list or an object around it."""
    ways = {1: F.concat(whole, F.lit("] trailing")), 2: F.concat(whole, F.lit("],["), whole), 3: F.concat(whole, F.lit('},"w":'), whole)}
    out = F.lit('{"id":')
    for n, text in ways.items():
        out = F.when(number % 4 == n, text).otherwise(out)
    return out


def faulty_records(events: DataFrame) -> DataFrame:
    """One record per event; 15 of every 20 have a fault or an odd header."""
    m = F.col("event_id") % 20
    good = _good_headers()
    headers = (
        F.when(m == 0, F.filter(good, lambda h: F.lit(False)))
        .when(m == 1, F.lit(None))
        .when(m == 2, build_headers(proto_schema="Event"))
        .when(m == 3, _good_headers(version="v1"))
        .when(m == 4, _good_headers("Notification"))
        .when(m == 5, _good_headers(version="2"))
        .when(m == 8, build_headers(proto_version="2"))
        .when(m == 10, F.concat(good, build_headers(proto_schema="Other")))
        .when(m == 11, F.concat(build_headers(proto_schema="Other"), good))
        .when(m == 12, _good_headers("event"))
        .when(m == 13, _good_headers(version="0"))
        .when(m == 14, _good_headers(version=""))
        .otherwise(good)
    )
    stamp = F.when(m == 9, F.lit("not-a-time")).otherwise(iso_utc(F.col("ts")))
    good_value = _value(stamp, F.col("event_type"))
    value = (
        F.when(m == 6, _with_text_behind(good_value.cast("string"), F.expr("event_id div 20")).cast("binary"))
        .when(m == 8, F.lit("{").cast("binary"))
        .when(m == 7, F.lit(None))
        .otherwise(good_value)
    )
    return events.select(*_record(headers, value, F.lit(EVENT_TOPIC)))


def two_topic_records(events: DataFrame) -> DataFrame:
    """Good records: purchases and signups are notifications, the rest events."""
    note = F.col("event_type").isin("purchase", "signup")
    name = F.when(note, F.lit("Notification")).otherwise(F.lit("Event"))
    topic = F.when(note, F.lit(NOTIFICATION_TOPIC)).otherwise(F.lit(EVENT_TOPIC))
    return events.select(*_record(_good_headers(name), _value(iso_utc(F.col("ts")), F.col("event_type")), topic))


def hourly_counters(events: DataFrame) -> DataFrame:
    """One counter per event type: the running sum of hourly values, reset every 200 hours seen."""
    hourly = events.groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum(F.col("value").cast(EXACT)).alias("v"))
    # One row per type and hour is left, so the windows are small.
    by_type = Window.partitionBy("event_type").orderBy("ts")
    numbered = hourly.withColumn("run", F.floor((F.row_number().over(by_type) - 1) / 200))
    running = Window.partitionBy("event_type", "run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.select(
        F.lit("events_value_total").alias("metric"),
        F.create_map(F.lit("event_type"), F.col("event_type")).alias("labels"),
        "ts",
        F.sum("v").over(running).cast("double").alias("value"),
    )


# The scrape clock of the derived samples, and their dashboards' labels.
SCRAPE_START = "2024-01-01 00:00:00"
SCRAPE_SECONDS = 15
SLOTS = 15
RESOURCE_KINDS = (
    "Kafka", "KafkaUser", "KafkaTopic", "KafkaConnect", "KafkaMirrorMaker2", "KafkaMirrorMaker", "KafkaBridge",
    "KafkaConnector", "KafkaRebalance",
)
OPERATOR_CONTAINERS = ("user-operator", "topic-operator", "strimzi-cluster-operator")


def _pick(values: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _scrape_time() -> Column:
    start = F.unix_micros(F.lit(SCRAPE_START).cast("timestamp"))
    return F.timestamp_micros(start + F.expr(f"event_id div {SLOTS}") * (SCRAPE_SECONDS * 1_000_000))


def _scrape_labels(dashboard: str, slot: Column) -> Column:
    topic, partition = slot % 5, F.floor(slot / 5).cast("string")
    pod = F.concat(F.lit("my-cluster-kafka-"), partition)
    labels = {
        "exporter": {
            "namespace": F.lit("kafka"),
            "strimzi_io_cluster": F.lit("my-cluster"),
            "topic": F.concat(F.lit("topic-"), topic),
            "partition": partition,
            "consumergroup": F.concat(F.lit("group-"), topic % 2),
        },
        "broker": {
            "namespace": F.lit("kafka"),
            "strimzi_io_cluster": F.lit("my-cluster"),
            "strimzi_io_name": F.lit("my-cluster-kafka"),
            "kubernetes_pod_name": pod,
            "pod": pod,
            "container": F.lit("kafka"),
            "persistentvolumeclaim": F.concat(F.lit("data-0-"), pod),
            "listener": F.when(topic < 2, F.lit("plain-9092")).otherwise(F.lit("tls-9093")),
            "topic": F.concat(F.lit("topic-"), topic),
            "partition": partition,
        },
        "operators": {
            "kind": _pick(RESOURCE_KINDS, slot),
            "container": _pick(OPERATOR_CONTAINERS, slot),
            "replica": slot.cast("string"),
        },
    }[dashboard]
    full = F.create_map(*[c for k, v in labels.items() for c in (F.lit(k), v)])
    without = F.create_map(*[c for k, v in labels.items() if k != "topic" for c in (F.lit(k), v)])
    # On the broker's board one target in five has no topic.
    return F.when(topic == 4, without).otherwise(full) if dashboard == "broker" else full


def scrape_samples(events: DataFrame, dashboard: str, metrics: Sequence[str]) -> DataFrame:
    """Samples of the given metrics as one dashboard's targets would report them, as chunks of an hour.

    Every 15 events are one scrape, 15 seconds after the one before, of 15
    targets: five topics by three partitions. Values rise by 500 a scrape and
    start over every 200 scrapes. Metrics and labels, by far the widest part of a sample, are
    given to the chunks of a target.
    """
    scrape, slot = F.expr(f"event_id div {SLOTS}"), F.col("event_id") % SLOTS
    scraped = events.select(
        slot.alias("slot"),
        _scrape_time().alias("ts"),
        (scrape % 200 * 500 + F.col("value")).alias("rising"),
        (F.col("event_id") % 2).cast("double").alias("flag"),
    )
    chunks = samples.chunked(scraped, ["slot"], ["rising", "flag"])
    points = F.when(F.col("metric").endswith("_is_preferred"), F.col("flag")).otherwise(F.col("rising"))
    return chunks.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics]))).select(
        "metric", _scrape_labels(dashboard, F.col("slot")).alias("labels"), points.alias("points"), "day"
    )


# One bean per kind of rule: domain, properties, attribute. ``{t}``, ``{p}`` and ``{n}`` are filled per event.
BEANS = (
    ("java.lang", "type=Memory", "HeapMemoryUsage", "used"),
    ("java.lang", "type=Memory", "NonHeapMemoryUsage", "committed"),
    ("java.lang", "type=MemoryPool, name=G1 {t} Gen", "Usage", "used"),
    ("java.lang", "type=GarbageCollector, name=G1 {t}", "", "CollectionCount"),
    ("java.lang", "type=GarbageCollector, name=G1 {t}", "", "CollectionTime"),
    ("java.lang", "type=Threading", "", "ThreadCount"),
    ("java.lang", "type=ClassLoading", "", "LoadedClassCount"),
    ("kafka.server", "type=FetcherLagMetrics, name=ConsumerLag, clientId=replica-{p}, topic={t}, partition={n}", "", "Value"),
    ("kafka.server", "type=Fetcher, name=MinFetchRate, clientId=replica-{p}, brokerHost=host-{n}, brokerPort=9091", "", "Value"),
    ("kafka.server", "type=socket-server-metrics, cipher=AES-{n}, protocol=TLSv1.3, listener={t}, networkProcessor={p}", "", "connections"),
    ("kafka.server", "type=socket-server-metrics, clientSoftwareName={t}, clientSoftwareVersion={n}.0, listener=TLS, networkProcessor={p}", "", "connections"),
    ("kafka.server", "type=socket-server-metrics, listener={t}, networkProcessor={p}", "", "connection-count"),
    ("kafka.server", "type=KafkaRequestHandlerPool, name=RequestHandlerAvgIdlePercent", "", "MeanRate"),
    ("kafka.network", "type=SocketServer, name=NetworkProcessorAvgIdlePercent", "", "Value"),
    ("kafka.network", "type=Processor, name=IdlePercent, networkProcessor={p}", "", "Value"),
    ("kafka.network", "type=RequestMetrics, name=RequestsPerSec, request={t}, version={n}", "", "Count"),
    ("kafka.server", "type=BrokerTopicMetrics, name=BytesInPerSec, topic={t}", "", "Count"),
    ("kafka.server", "type=BrokerTopicMetrics, name=MessagesInPerSec", "", "Count"),
    ("kafka.cluster", "type=Partition, name=UnderMinIsr, topic={t}, partition={n}", "", "Value"),
    ("kafka.server", "type=DelayedOperationPurgatory, name=PurgatorySize, delayedOperation={t}", "", "Value"),
    ("kafka.server", "type=ReplicaManager, name=LeaderCount", "", "Value"),
    ("kafka.network", "type=RequestMetrics, name=TotalTimeMs, request={t}, version={n}", "", "Count"),
    ("kafka.network", "type=RequestMetrics, name=TotalTimeMs, request={t}, version={n}", "", "99thPercentile"),
    ("kafka.network", "type=RequestMetrics, name=LocalTimeMs, request={t}", "", "Count"),
    ("kafka.network", "type=RequestMetrics, name=LocalTimeMs, request={t}", "", "95thPercentile"),
    ("kafka.log", "type=LogFlushStats, name=LogFlushRateAndTimeMs", "", "Count"),
    ("kafka.log", "type=LogFlushStats, name=LogFlushRateAndTimeMs", "", "999thPercentile"),
    ("kafka.utils", "type=Throttler", "", "Other"),
    ("kafka.cruisecontrol", "name=LoadMonitor.{t}", "", "Value"),
)


def _bean() -> Column:
    index = (F.col("event_id") % len(BEANS) + 1).cast("int")

    def part(position: int) -> Column:
        return F.element_at(F.array(*[F.lit(b[position]) for b in BEANS]), index)

    properties = part(1)
    for mark, value in (("{t}", F.col("event_type")), ("{p}", (F.col("event_id") % 3).cast("string")), ("{n}", (F.col("user_id") % 7).cast("string"))):
        properties = F.replace(properties, F.lit(mark), value)
    return bean_text(part(0), properties, part(3), part(2))


def beans(events: DataFrame) -> DataFrame:
    """One raw bean attribute per event: ``event_id, bean, value``."""
    return events.select("event_id", _bean().alias("bean"), "value")


def scraped_beans(events: DataFrame) -> DataFrame:
    """Beans with the time of their scrape and the metadata labels of their target."""
    return events.select(_bean().alias("bean"), _target_labels().alias("labels"), _scrape_time().alias("ts"), "value")


def _target_labels() -> Column:
    n = (F.col("user_id") % 5).cast("string")
    labels = {
        "__meta_kubernetes_namespace": F.lit("kafka"),
        "__meta_kubernetes_pod_name": F.concat(F.lit("my-cluster-kafka-"), n),
        "__meta_kubernetes_pod_node_name": F.concat(F.lit("node-"), n),
        "__meta_kubernetes_pod_host_ip": F.concat(F.lit("10.0.0."), n),
        "__meta_kubernetes_pod_label_strimzi_io_cluster": F.lit("my-cluster"),
        "__meta_kubernetes_pod_label_strimzi_io_kind": _pick(RESOURCE_KINDS, F.col("event_id")),
        "__meta_kubernetes_pod_label_app": F.lit("web"),
        "namespace": F.col("event_type"),
    }
    return F.create_map(*[c for k, v in labels.items() for c in (F.lit(k), v)])


def pod_targets(events: DataFrame) -> DataFrame:
    """Samples as scraped, with the metadata labels of their pod."""
    return events.select("event_id", F.lit("up").alias("metric"), _target_labels().alias("labels"), "ts", "value")


def _pod_path() -> Column:
    n = (F.col("user_id") % 7).cast("string")
    namespace = F.when(F.col("user_id") % 2 == 0, F.lit("kafka")).otherwise(F.lit("shop"))
    key = F.concat(F.lit("web-"), n, F.lit("_"), namespace)
    # The container id is 64 hexadecimal digits.
    return F.concat(F.lit("/var/log/containers/"), key, F.lit("_main-"), F.md5(key), F.md5(key), F.lit(".log"))


def log_lines(events: DataFrame) -> DataFrame:
    """One log line per event: plain text, JSON, or JSON that is cut off."""
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("event")))
    log = (
        F.when(F.col("event_id") % 11 == 0, _with_text_behind(body, F.expr("event_id div 11")))
        .when(F.col("event_id") % 4 == 0, F.concat_ws(" ", F.lit("event"), F.col("event_id"), F.col("event_type")))
        .otherwise(body)
    )
    stream = F.when(F.col("event_id") % 2 == 0, F.lit("stdout")).otherwise(F.lit("stderr"))
    return events.select("event_id", _pod_path().alias("path"), "ts", stream.alias("stream"), log.alias("log"))


def container_lines(events: DataFrame, size: int = 16) -> DataFrame:
    """The raw lines of ``log_lines`` by the name of their file, long messages cut into partial pieces."""
    pieces = F.regexp_extract_all("log", F.lit("(?s).{1,%d}" % size), F.lit(0))
    cut = log_lines(events).select(
        "event_id",
        F.substring_index("path", "/", -1).alias("name"),
        "ts",
        "stream",
        F.size(pieces).alias("pieces"),
        F.posexplode(pieces).alias("n", "piece"),
    )
    flag = F.when(F.col("n") < F.col("pieces") - 1, F.lit("P")).otherwise(F.lit("F"))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return cut.select("name", "event_id", "n", F.concat_ws(" ", time, "stream", flag, "piece").alias("value"))


def write_container_files(lines: DataFrame, folder: str, events_per_file: int = 1_000_000) -> None:
    """Files of each container, one for so many events; a file that was there is replaced, as if it had grown.

    They get their names one by one, so there should not be many small ones.
    """
    spark = lines.sparkSession
    staged = work_dir(spark, "container-files")
    spread = lines.withColumn("range", F.floor(F.col("event_id") / events_per_file))
    ordered = spread.repartition("range", "name").sortWithinPartitions("range", "name", "event_id", "n")
    ordered.select("range", "name", "value").write.partitionBy("range", "name").text(staged)
    for held in paths.children(spark, staged):
        for name in paths.children(spark, f"{staged}/{held}") if held.startswith("range=") else ():
            for part in paths.children(spark, f"{staged}/{held}/{name}"):
                if part.startswith("part-"):
                    paths.move(spark, f"{staged}/{held}/{name}/{part}", f"{folder}/{held}/{name.removeprefix('name=')}")


def pods(events: DataFrame) -> DataFrame:
    """Metadata of the pods whose number is not 6."""
    number = F.col("user_id") % 7
    namespace = F.when(F.col("user_id") % 2 == 0, F.lit("kafka")).otherwise(F.lit("shop"))
    return events.where(number != 6).select(
        namespace.alias("namespace"),
        F.concat(F.lit("web-"), number.cast("string")).alias("pod_name"),
        F.concat(F.lit("node-"), (number % 3).cast("string")).alias("node_name"),
        F.when(number < 3, F.lit("front")).otherwise(F.lit("back")).alias("app"),
    )


def text_pieces(documents: DataFrame, size: int = 120) -> DataFrame:
    """The lines of all documents as container logs, long lines cut into partial pieces.

    A file per source. ``line_no`` orders the pieces of a file, ``block`` stands
    for the split of the file they would be read from; a block ends in the
    middle of a text.
    """

    def cut(line: Column) -> Column:
        pieces = F.when(line == "", F.array(F.lit(""))).otherwise(
            F.regexp_extract_all(line, F.lit("(?s).{1,%d}" % size), F.lit(0))
        )
        return F.transform(pieces, lambda p, i: F.struct(p.alias("log"), (i < F.size(pieces) - 1).alias("partial")))

    pieces = documents.select(
        F.concat(F.lit("/var/log/containers/"), F.col("source"), F.lit(".log")).alias("path"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("stdout")).otherwise(F.lit("stderr")).alias("stream"),
        "doc_id",
        F.timestamp_seconds(F.col("doc_id")).alias("ts"),
        F.posexplode(F.flatten(F.transform(F.split("text", "\n"), cut))).alias("n", "piece"),
    )
    # A text has less than 2^31 pieces.
    place = F.col("doc_id") * F.lit(2**31) + F.col("n")
    return pieces.select(
        "path", "stream", place.alias("line_no"), F.floor((place - 8) / (64 * 2**31)).alias("block"), "ts", "piece.partial", "piece.log"
    )
