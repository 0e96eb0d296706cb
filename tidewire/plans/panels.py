"""Dashboards: what each panel shows, and one pass that evaluates many panels.

A panel is a metric, matchers, a range function, and a sum or count over
labels. ``evaluate`` computes one panel. ``evaluate_all`` runs each distinct
range function once over all the metrics that need it, instead of one job per
panel, so the plan grows with the number of range functions (seven here) and
not with the number of panels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce
from string import Template

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import SERIES, Matcher, entries, label, label_text, legend, matches, series_id
from tidewire.operators import aggregates, ranges


@dataclass(frozen=True)
class Panel:
    """``matchers`` are ``(label, op, value)`` with ``$name`` for a dashboard variable.

    ``over`` is the range function, ``window`` its width in seconds; ``agg`` is
    ``sum``, ``count`` or ``none``; ``factor`` multiplies every series before
    it is summed; ``below`` turns it into 1 or 0.
    """

    dashboard: str
    title: str
    metric: str
    agg: str
    matchers: tuple[tuple[str, str, str], ...] = ()
    over: str = "instant"
    window: int = 300
    by: tuple[str, ...] = ()
    factor: float = 1.0
    below: float | None = None
    legend: str = ""

    def conditions(self, variables: Mapping[str, str]) -> list[Matcher]:
        return [Matcher(name, op, Template(value).substitute(variables)) for name, op, value in self.matchers]

    @property
    def call(self) -> tuple[str, int]:
        return self.over, self.window


# Label conditions that several panels share.
_TOPIC = (("topic", "=~", "$topic"), ("namespace", "=~", "$kubernetes_namespace"))
_TOPIC_EXACT = (("topic", "=~", "$topic"), ("namespace", "=", "$kubernetes_namespace"))
_GROUP = (("consumergroup", "=~", "$consumergroup"), *_TOPIC)
_CLUSTER = (("namespace", "=", "$kubernetes_namespace"), ("strimzi_io_cluster", "=", "$strimzi_cluster_name"))
_BROKER_POD = ("kubernetes_pod_name", "=~", "$strimzi_cluster_name-$kafka_broker")
_BROKER = (*_CLUSTER, _BROKER_POD)
_BROKER_TOPIC = (*_CLUSTER, ("topic", "=~", "$kafka_topic"), ("topic", "!=", ""), _BROKER_POD)
_CONTAINER = (
    ("namespace", "=", "$kubernetes_namespace"),
    ("pod", "=~", "$strimzi_cluster_name-$kafka_broker"),
    ("container", "=", "kafka"),
)
_DISK = (
    ("namespace", "=", "$kubernetes_namespace"),
    ("persistentvolumeclaim", "=~", "data(-[0-9]+)?-$strimzi_cluster_name-kafka-[0-9]+"),
)
_PROCESS = (("namespace", "=", "$kubernetes_namespace"), _BROKER_POD, ("container", "=", "kafka"))
_JVM = (
    ("namespace", "=", "$kubernetes_namespace"),
    _BROKER_POD,
    ("strimzi_io_name", "=", "$strimzi_cluster_name-kafka"),
)
_LOG = (*_BROKER, ("topic", "=~", "$kafka_topic"), ("partition", "=~", "$kafka_partition"))
_OPERATORS = (("container", "=~", "user-operator|topic-operator|strimzi-cluster-operator"),)

_POD = ("kubernetes_pod_name",)
_POD_LEGEND = "{{kubernetes_pod_name}}"


def _exporter(title: str, metric: str, agg: str = "sum", matchers=_TOPIC, **more) -> Panel:
    return Panel("exporter", title, metric, agg, matchers, **more)


def _broker(title: str, metric: str, agg: str = "sum", matchers=_CLUSTER, **more) -> Panel:
    return Panel("broker", title, metric, agg, matchers, **more)


def _served(title: str, metric: str, text: str = "") -> Panel:
    return _broker(title, metric, matchers=_BROKER_TOPIC, over="irate", window=60, legend=text)


def _per_pod(title: str, metric: str, matchers=_BROKER, **more) -> Panel:
    return _broker(title, metric, matchers=matchers, by=_POD, legend=_POD_LEGEND, **more)


def _resources(title: str, kind: str) -> Panel:
    return Panel("operators", title, "strimzi_resources", "sum", (("kind", "=", kind),))


def _reconciled(title: str, metric: str, **more) -> Panel:
    return Panel("operators", title, metric, "sum", by=("kind",), legend="{{kind}}", **more)


def _operator(title: str, metric: str, **more) -> Panel:
    return Panel(
        "operators", title, metric, "sum", _OPERATORS, by=("container",), legend="{{container}}", **more
    )


_HOUR = {"over": "increase", "window": 3600}
_RATE_5M = {"over": "rate", "window": 300}
_IRATE_1M = {"over": "irate", "window": 60}

# The panels of the three dashboards, in order.
PANELS: tuple[Panel, ...] = (
    _exporter("Topics", "kafka_topic_partitions", "count"),
    _exporter("Partitions", "kafka_topic_partitions"),
    _exporter("Replicas", "kafka_topic_partition_replicas", matchers=_TOPIC_EXACT),
    _exporter("In Sync Replicas", "kafka_topic_partition_in_sync_replica"),
    _exporter("Under Replicated Partitions", "kafka_topic_partition_under_replicated_partition"),
    _exporter("Partitions at minimum ISR", "kafka_cluster_partition_atminisr"),
    _exporter("Partitions under minimum ISR", "kafka_cluster_partition_underminisr"),
    _exporter("Partitions not on preferred node", "kafka_topic_partition_leader_is_preferred", below=1.0),
    _exporter(
        "Messages in per second", "kafka_topic_partition_current_offset",
        over="rate", window=60, by=("topic",), legend="{{topic}}",
    ),
    _exporter(
        "Messages consumed per second", "kafka_consumergroup_current_offset", matchers=_GROUP,
        over="delta", window=60, factor=1 / 60, by=("consumergroup", "topic"),
        legend="{{consumergroup}} (topic: {{topic}})",
    ),
    _exporter(
        "Lag by Consumer Group", "kafka_consumergroup_lag", matchers=_GROUP,
        by=("consumergroup", "topic"), legend="{{consumergroup}} (topic: {{topic}})",
    ),
    _exporter(
        "Consumer Group Offsets", "kafka_consumergroup_current_offset", matchers=_GROUP,
        by=("consumergroup", "partition", "topic"), legend="{{topic}}",
    ),
    _exporter(
        "Consumer Group Lag", "kafka_consumergroup_lag", matchers=_GROUP,
        by=("consumergroup", "partition", "topic"), legend="{{topic}}",
    ),
    _exporter("Number of Partitions", "kafka_topic_partitions", by=("topic",), legend="{{topic}}"),
    _exporter(
        "Latest Offsets", "kafka_topic_partition_current_offset", by=("partition", "topic"), legend="{{topic}}"
    ),
    _exporter(
        "Oldest Offsets", "kafka_topic_partition_oldest_offset", by=("partition", "topic"), legend="{{topic}}"
    ),
    _broker("Brokers Online", "kafka_server_replicamanager_leadercount", "count"),
    _broker("Active Controllers", "kafka_controller_kafkacontroller_activecontrollercount"),
    _broker(
        "Unclean Leader Election Rate", "kafka_controller_controllerstats_uncleanleaderelections_total",
        over="irate", window=300,
    ),
    _broker("Online Replicas", "kafka_server_replicamanager_partitioncount"),
    _broker("Under Replicated Partitions", "kafka_server_replicamanager_underreplicatedpartitions"),
    _broker("Partitions at minimum ISR", "kafka_cluster_partition_atminisr"),
    _broker("Partitions under minimum ISR", "kafka_cluster_partition_underminisr"),
    _broker("Offline Partitions Count", "kafka_controller_kafkacontroller_offlinepartitionscount"),
    _broker("Memory Usage", "container_memory_usage_bytes", matchers=_CONTAINER, by=("pod",), legend="{{pod}}"),
    _broker(
        "CPU Usage", "container_cpu_usage_seconds_total", matchers=_CONTAINER, by=("pod",), legend="{{pod}}",
        **_RATE_5M,
    ),
    _broker(
        "Available Disk Space", "kubelet_volume_stats_available_bytes", matchers=_DISK,
        by=("persistentvolumeclaim",), legend="{{persistentvolumeclaim}}",
    ),
    _per_pod("Open File Descriptors", "process_open_fds", _PROCESS),
    _per_pod("JVM Memory Used", "jvm_memory_bytes_used", _JVM),
    _per_pod("JVM GC Time", "jvm_gc_collection_seconds_sum", _JVM, **_RATE_5M),
    _per_pod("JVM GC Count", "jvm_gc_collection_seconds_count", _JVM, **_RATE_5M),
    _per_pod("JVM Thread Count", "jvm_threads_current", _JVM),
    _served("Total Incoming Byte Rate", "kafka_server_brokertopicmetrics_bytesin_total"),
    _served("Total Outgoing Byte Rate", "kafka_server_brokertopicmetrics_bytesout_total"),
    _served("Incoming Messages Rate", "kafka_server_brokertopicmetrics_messagesin_total"),
    _served("Total Produce Request Rate", "kafka_server_brokertopicmetrics_totalproducerequests_total"),
    _served("Byte Rate", "kafka_server_brokertopicmetrics_bytesin_total", "Total Incoming Byte Rate"),
    _served("Byte Rate", "kafka_server_brokertopicmetrics_bytesout_total", "Total Outgoing Byte Rate"),
    _served("Messages In Per Second", "kafka_server_brokertopicmetrics_messagesin_total", "Total Incoming Messages Rate"),
    _served("Produce Request Rate", "kafka_server_brokertopicmetrics_totalproducerequests_total", "Total Produce Request Rate"),
    _served("Produce Request Rate", "kafka_server_brokertopicmetrics_failedproducerequests_total", "Failed Produce Request Rate"),
    _served("Fetch Request Rate", "kafka_server_brokertopicmetrics_totalfetchrequests_total", "Fetch Request Rate"),
    _served("Fetch Request Rate", "kafka_server_brokertopicmetrics_failedfetchrequests_total", "Failed Fetch Request Rate"),
    _per_pod("Network Processor Avg Idle Percent", "kafka_network_socketserver_networkprocessoravgidle_percent", factor=100.0),
    _per_pod(
        "Request Handler Avg Idle Percent", "kafka_server_kafkarequesthandlerpool_requesthandleravgidle_percent",
        factor=100.0,
    ),
    _per_pod("Disk Writes", "kafka_server_kafkaserver_linux_disk_write_bytes", **_IRATE_1M),
    _per_pod("Disk Reads", "kafka_server_kafkaserver_linux_disk_read_bytes", **_IRATE_1M),
    _broker(
        "Connection Count per Listener", "kafka_server_socket_server_metrics_connection_count", matchers=_BROKER,
        by=("kubernetes_pod_name", "listener"), legend="{{listener}}-{{kubernetes_pod_name}}",
    ),
    _broker("Log Size", "kafka_log_log_size", "none", _LOG, legend="{{topic}}:{{partition}}"),
    _resources("Kafka CRs", "Kafka"),
    _resources("User CRs", "KafkaUser"),
    _resources("Topics CRs", "KafkaTopic"),
    _resources("Connect CRs", "KafkaConnect"),
    _resources("Mirror Maker 2 CRs", "KafkaMirrorMaker2"),
    _resources("Mirror Maker CRs", "KafkaMirrorMaker"),
    _resources("Bridge CRs", "KafkaBridge"),
    _resources("Connector CRs", "KafkaConnector"),
    _resources("Rebalance CRs", "KafkaRebalance"),
    _reconciled("Successful Reconciliation per hour", "strimzi_reconciliations_successful_total", **_HOUR),
    _reconciled("Failed Reconciliation per hour", "strimzi_reconciliations_failed_total", **_HOUR),
    _reconciled("Reconciliation without Lock per hour", "strimzi_reconciliations_locked_total", **_HOUR),
    _reconciled("Started Reconciliation per hour", "strimzi_reconciliations_total", **_HOUR),
    _reconciled("Periodical Reconciliation per hour", "strimzi_reconciliations_periodical_total", **_HOUR),
    _reconciled("Maximum reconciliation time", "strimzi_reconciliations_duration_seconds_max"),
    _operator("JVM Memory Used", "jvm_memory_used_bytes"),
    _operator("JVM GC Time", "jvm_gc_pause_seconds_sum", **_RATE_5M),
    _operator("JVM GC Count", "jvm_gc_pause_seconds_count", **_RATE_5M),
)

# What the variables stand for when nothing is chosen. The
# namespace and the cluster have no such value: one of each must be chosen.
ALL_VALUES = {
    "topic": ".*",
    "consumergroup": ".*",
    "kafka_broker": ".*",
    "kafka_topic": ".+",
    "kafka_partition": ".*",
}


@dataclass(frozen=True)
class Variable:
    """A list of choices: the values of ``label``, or the captures of ``pattern``."""

    dashboard: str
    name: str
    metric: str
    matchers: tuple[tuple[str, str, str], ...] = ()
    label: str = ""
    pattern: str = ""


_LEADERS = "kafka_server_replicamanager_leadercount"

# The choice lists of the dashboards, in order.
VARIABLES: tuple[Variable, ...] = (
    Variable("exporter", "kubernetes_namespace", "kafka_exporter_build_info", pattern='.*namespace="([^"]*).*'),
    Variable(
        "exporter", "strimzi_cluster_name", "kafka_exporter_build_info", _CLUSTER[:1],
        pattern='.*strimzi_io_cluster="([^"]*).*',
    ),
    Variable("exporter", "consumergroup", "kafka_consumergroup_current_offset", _CLUSTER, label="consumergroup"),
    Variable("exporter", "topic", "kafka_topic_partition_current_offset", _CLUSTER, label="topic"),
    Variable("broker", "kubernetes_namespace", _LEADERS, pattern='.*namespace="([^"]*).*'),
    Variable("broker", "strimzi_cluster_name", _LEADERS, _CLUSTER[:1], pattern='.*strimzi_io_cluster="([^"]*).*'),
    Variable("broker", "kafka_broker", _LEADERS, _CLUSTER, pattern='.*pod_name="$strimzi_cluster_name-([^"]*).*'),
    Variable("broker", "kafka_topic", "kafka_cluster_partition_replicascount", _BROKER, pattern='.*topic="([^"]*).*'),
    Variable("broker", "kafka_partition", "kafka_log_log_size", _LOG[:-1], pattern='.*partition="([^"]*).*'),
)


def choices(samples: DataFrame, variable: Variable, chosen: Mapping[str, str] | None = None) -> DataFrame:
    """The values a dashboard variable can take, sorted."""
    values = {**ALL_VALUES, **(chosen or {})}
    conditions = [Matcher(n, op, Template(v).substitute(values)) for n, op, v in variable.matchers]
    rows = samples.where(F.col("metric") == variable.metric).where(matches(conditions))
    if variable.label:
        return aggregates.label_values(rows, variable.label)
    return aggregates.captured_values(rows, Template(variable.pattern).safe_substitute(values))


def all_choices(samples: DataFrame, dashboard: str, chosen: Mapping[str, str] | None = None) -> DataFrame:
    """``variable, value`` of all variables of a dashboard, as ``choices`` gives them one by one.

    Samples are reduced to series in one pass; a series then gives its value to each
    variable that it matches.
    """
    values = {**ALL_VALUES, **(chosen or {})}
    asked = [v for v in VARIABLES if v.dashboard == dashboard]
    rows = samples.where(F.col("metric").isin(sorted({v.metric for v in asked})))
    series = aggregates.distinct_maps(rows).groupBy("metric", entries("labels").alias("pairs")).agg(F.sum("seen").alias("seen"))
    # Both depend on the count, so neither is worked out on every sample.
    series = series.select(
        "metric",
        F.when(F.col("seen") > 0, F.map_from_entries("pairs")).alias("labels"),
        F.when(F.col("seen") > 0, aggregates.series_text()).alias("text"),
    )

    def given(variable: Variable) -> Column:
        conditions = [Matcher(n, op, Template(v).substitute(values)) for n, op, v in variable.matchers]
        if variable.label:
            value, has = label(variable.label), label(variable.label) != ""
        else:
            pattern = Template(variable.pattern).safe_substitute(values)
            value, has = F.regexp_extract("text", pattern, 1), F.col("text").rlike(pattern)
        hit = (F.col("metric") == variable.metric) & matches(conditions) & has
        return F.when(hit, F.struct(F.lit(variable.name).alias("variable"), value.alias("value")))

    pairs = F.explode(F.array_compact(F.array(*map(given, asked)))).alias("given")
    return series.select(pairs).select("given.*").distinct()


def _window(panel: Panel) -> timedelta:
    return timedelta(seconds=panel.window)


def _shown(panel: Panel) -> Column:
    value = F.col("value")
    if panel.below is not None:
        value = (value < F.lit(panel.below)).cast("double")
    return value if panel.factor == 1.0 else value * F.lit(panel.factor)


def _legend(panel: Panel) -> Column:
    return legend(panel.legend) if panel.legend else F.lit("")


def evaluate(
    samples: DataFrame, panel: Panel, grid: ranges.Grid, chosen: Mapping[str, str] | None = None
) -> DataFrame:
    """One panel: the ``by`` labels, ``ts`` and ``value``; all labels when nothing is summed."""
    values = {**ALL_VALUES, **(chosen or {})}
    rows = samples.where(F.col("metric") == panel.metric).where(matches(panel.conditions(values)))
    keep = None if panel.agg == "none" else {name: label(name) for name in panel.by}
    series = ranges.FUNCTIONS[panel.over](rows, grid, _window(panel), keep=keep).withColumn("value", _shown(panel))
    if panel.agg == "none":
        return series.select("labels", _legend(panel).alias("legend"), "ts", "value")
    return {"sum": aggregates.sum_by, "count": aggregates.count_by}[panel.agg](series, panel.by)


def evaluate_all(
    samples: DataFrame,
    grid: ranges.Grid,
    panels: Sequence[tuple[int, Panel]],
    chosen: Mapping[str, str] | None = None,
    chunks: DataFrame | None = None,
) -> DataFrame:
    """Many panels at once: ``panel, labels, legend, ts, value``.

    ``labels`` is the text of the labels a panel keeps, such as ``topic=a``. The series are
    looked up in the ``chunks`` that the samples come from, where these are given.
    """
    values = {**ALL_VALUES, **(chosen or {})}
    # Many panels have the same conditions: each distinct set is evaluated once.
    sets = list(dict.fromkeys(tuple(p.conditions(values)) for _, p in panels))
    set_of = {n: f"match_{sets.index(tuple(p.conditions(values)))}" for n, p in panels}
    rows = samples.where(F.col("metric").isin(sorted({p.metric for _, p in panels})))
    calls = sorted({p.call for _, p in panels})
    rows = ranges.in_reach(rows, grid, timedelta(seconds=max(window for _, window in calls)))

    def points_of(call: tuple[str, int]) -> DataFrame:
        wanted: dict[str, set[str]] = {}
        for n, p in panels:
            if p.call == call:
                wanted.setdefault(set_of[n], set()).add(p.metric)
        hits = [
            F.col("metric").isin(sorted(wanted[name])) & matches(conditions)
            for name, conditions in ((f"match_{k}", c) for k, c in enumerate(sets))
            if name in wanted
        ]
        over, window = call
        chosen_rows = rows.where(reduce(lambda a, b: a | b, hits))
        found = ranges.FUNCTIONS[over](chosen_rows, grid, timedelta(seconds=window), keep={})
        return found.withColumn("call", F.lit(calls.index(call)))

    points = [points_of(call) for call in calls]
    # One row per series and panel that shows it. The labels depend on the count,
    # or the test for a panel would move below the aggregate and run on every sample.
    shares = F.array(
        *[
            F.when((F.col("metric") == p.metric) & F.col(set_of[n]), _share(n, p, calls.index(p.call)))
            for n, p in panels
        ]
    )
    held = rows if chunks is None else chunks.where(F.col("metric").isin(sorted({p.metric for _, p in panels})))
    series = aggregates.distinct_maps(held).groupBy(*series_id(), "metric", entries("labels").alias("pairs")).agg(F.sum("seen").alias("seen"))
    shown = (
        series.withColumn("labels", F.when(F.col("seen") > 0, F.map_from_entries("pairs")))
        .withColumns({f"match_{k}": matches(conditions) for k, conditions in enumerate(sets)})
        .select(*SERIES, F.explode(F.array_compact(shares)).alias("share"))
        .select(*SERIES, "share.*")
    )
    every = reduce(DataFrame.unionByName, points).join(shown, [*SERIES, "call"])
    summed = every.groupBy("panel", "labels", "legend", "ts").agg(
        aggregates.exact_sum(_by_panel(panels, _shown)).alias("total"), F.count("value").alias("series")
    )
    counting = [n for n, p in panels if p.agg == "count"]
    value = F.when(F.col("panel").isin(counting), F.col("series").cast("double")).otherwise(F.col("total"))
    return summed.select("panel", "labels", "legend", "ts", value.alias("value"))


def _by_panel(panels: Sequence[tuple[int, Panel]], shown) -> Column:
    """The shown value of each panel; most show the value as it is."""
    out = F.col("value")
    for number, panel in panels:
        if panel.factor != 1.0 or panel.below is not None:
            out = F.when(F.col("panel") == number, shown(panel)).otherwise(out)
    return out


def _share(number: int, panel: Panel, call: int) -> Column:
    kept = label_text(None if panel.agg == "none" else panel.by)
    text = _legend(panel) if panel.agg == "none" or panel.by else F.lit(panel.legend)
    return F.struct(F.lit(call).alias("call"), F.lit(number).alias("panel"), kept.alias("labels"), text.alias("legend"))


def dashboard(name: str) -> list[tuple[int, Panel]]:
    """Numbered panels of one dashboard."""
    return [(n, p) for n, p in enumerate(PANELS, start=1) if p.dashboard == name]

