"""The metric job: raw beans and the labels of their target in, samples out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import naming, relabel
from tidewire.sources import samples

RULES = (*naming.BROKER_RULES, *naming.REBALANCER_RULES)


def sampled(beans: DataFrame, rules: Sequence[naming.Rule] = RULES, kinds: Sequence[str] = relabel.SCRAPED_KINDS) -> DataFrame:
    """``metric, labels, ts, value`` of beans with ``bean, value, ts`` and ``labels``, those of the target.

    Targets of other kinds are left out before anything is named. A label that both
    the bean and its target have is the target's; the bean's becomes ``exported_`` and
    its name.
    """
    targets = relabel.scraped_targets(beans, kinds)
    named = naming.normalize(targets.withColumnRenamed("labels", "target"), rules)
    own = F.transform_keys(
        "labels",
        lambda k, _: F.when(F.map_contains_key("target", k), F.concat(F.lit("exported_"), k)).otherwise(k),
    )
    return named.withColumn("labels", F.map_concat(own, "target")).select(*samples.SAMPLE_SCHEMA.names)


def collect(beans: DataFrame, path: str, **settings) -> None:
    """Append the samples of scraped beans to a sample table."""
    samples.write(sampled(beans, **settings), path)
