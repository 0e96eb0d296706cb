"""Relabelling of scraped targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import label, labelmap, replace_labels
from tidewire.session import work_dir

# Pod labels that are copied, and where pod metadata goes.
POD_LABEL_PREFIX = "__meta_kubernetes_pod_label_"
POD_LABEL_KEEP = "strimzi_io_"
POD_TARGETS = {
    "__meta_kubernetes_namespace": "namespace",
    "__meta_kubernetes_pod_name": "kubernetes_pod_name",
    "__meta_kubernetes_pod_node_name": "node_name",
    "__meta_kubernetes_pod_host_ip": "node_ip",
}
# The kinds of resource whose pods are scraped.
SCRAPED_KINDS = ("Kafka", "KafkaConnect", "KafkaMirrorMaker", "KafkaMirrorMaker2")


def relabel_pods(df: DataFrame, drop_meta: bool = False) -> DataFrame:
    """Give samples the labels of their pod, namespace and node.

    ``drop_meta`` removes the ``__`` labels afterwards, as a store would.
    """
    out = df.withColumn("labels", labelmap(POD_LABEL_PREFIX, keep=POD_LABEL_KEEP))
    out = out.withColumn("labels", replace_labels(POD_TARGETS))
    if drop_meta:
        out = out.withColumn("labels", F.map_filter("labels", lambda k, v: ~k.startswith("__")))
    return out


def scraped_targets(df: DataFrame, kinds: Sequence[str] = SCRAPED_KINDS) -> DataFrame:
    """Samples of the targets of some kinds, with ``relabel_pods`` done and their ``__`` labels removed.

    Work on maps is far dearer than a scan, and the labels of a target depend neither on
    time nor on value. So they are worked out once per distinct map, and a join brings them back.
    They are written first: then it is known how small they are, where a guess could take the
    samples for the smaller side and send these to all tasks.
    """
    held = {"label_names": F.map_keys("labels"), "label_values": F.map_values("labels")}
    rows = df.withColumns(held).drop("labels")
    sets = rows.groupBy(*held).agg(F.count("*").alias("seen"))
    # The map depends on the count, or it would be made, and relabelled, on every sample.
    sets = sets.select(*held, F.when(F.col("seen") > 0, F.map_from_arrays(*held)).alias("labels"))
    targets = relabel_pods(sets, drop_meta=True).where(label("strimzi_io_kind").isin(*kinds))
    staged = work_dir(df.sparkSession, "targets")
    targets.write.parquet(staged)
    return rows.join(df.sparkSession.read.schema(targets.schema).parquet(staged), [*held]).drop(*held)
