"""Naming of raw bean attributes: ordered regex rules, the first match wins."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAUGE = "GAUGE"
COUNTER = "COUNTER"


@dataclass(frozen=True)
class Rule:
    """``name``, label names and label values are templates with ``$n`` for group n."""

    pattern: str
    name: str
    kind: str = GAUGE
    labels: dict[str, str] = field(default_factory=dict)


# Broker rules, in order.
BROKER_RULES: tuple[Rule, ...] = (
    Rule(r"java.lang<type=Memory><HeapMemoryUsage>(\w+)", "jvm_memory_bytes_$1", GAUGE, {"area": "heap"}),
    Rule(r"java.lang<type=Memory><NonHeapMemoryUsage>(\w+)", "jvm_memory_bytes_$1", GAUGE, {"area": "nonheap"}),
    Rule(r"java.lang<type=MemoryPool, name=(.+)><Usage>(\w+)", "jvm_memory_pool_bytes_$2", GAUGE, {"pool": "$1"}),
    Rule(r"java.lang<type=GarbageCollector, name=(.+)><>CollectionCount", "jvm_gc_collection_seconds_count", COUNTER, {"gc": "$1"}),
    Rule(r"java.lang<type=GarbageCollector, name=(.+)><>CollectionTime", "jvm_gc_collection_seconds_sum", COUNTER, {"gc": "$1"}),
    Rule(r"java.lang<type=Threading><>(\w+)", "jvm_threads_$1", GAUGE),
    Rule(r"java.lang<type=ClassLoading><>(\w+)", "jvm_classes_$1", GAUGE),
    Rule(r"kafka.server<type=(.+), name=(.+), clientId=(.+), topic=(.+), partition=(.*)><>Value", "kafka_server_$1_$2", GAUGE, {"clientId": "$3", "topic": "$4", "partition": "$5"}),
    Rule(r"kafka.server<type=(.+), name=(.+), clientId=(.+), brokerHost=(.+), brokerPort=(.+)><>Value", "kafka_server_$1_$2", GAUGE, {"clientId": "$3", "broker": "$4:$5"}),
    Rule(r"kafka.server<type=(.+), cipher=(.+), protocol=(.+), listener=(.+), networkProcessor=(.+)><>connections", "kafka_server_$1_connections_tls_info", GAUGE, {"cipher": "$2", "protocol": "$3", "listener": "$4", "networkProcessor": "$5"}),
    Rule(r"kafka.server<type=(.+), clientSoftwareName=(.+), clientSoftwareVersion=(.+), listener=(.+), networkProcessor=(.+)><>connections", "kafka_server_$1_connections_software", GAUGE, {"clientSoftwareName": "$2", "clientSoftwareVersion": "$3", "listener": "$4", "networkProcessor": "$5"}),
    Rule(r"kafka.server<type=(.+), listener=(.+), networkProcessor=(.+)><>(.+):", "kafka_server_$1_$4", GAUGE, {"listener": "$2", "networkProcessor": "$3"}),
    Rule(r"kafka.server<type=(.+), listener=(.+), networkProcessor=(.+)><>(.+)", "kafka_server_$1_$4", GAUGE, {"listener": "$2", "networkProcessor": "$3"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)Percent\w*><>MeanRate", "kafka_$1_$2_$3_percent", GAUGE),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)Percent\w*><>Value", "kafka_$1_$2_$3_percent", GAUGE),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)Percent\w*, (.+)=(.+)><>Value", "kafka_$1_$2_$3_percent", GAUGE, {"$4": "$5"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)PerSec\w*, (.+)=(.+), (.+)=(.+)><>Count", "kafka_$1_$2_$3_total", COUNTER, {"$4": "$5", "$6": "$7"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)PerSec\w*, (.+)=(.+)><>Count", "kafka_$1_$2_$3_total", COUNTER, {"$4": "$5"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)PerSec\w*><>Count", "kafka_$1_$2_$3_total", COUNTER),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+), (.+)=(.+), (.+)=(.+)><>Value", "kafka_$1_$2_$3", GAUGE, {"$4": "$5", "$6": "$7"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+), (.+)=(.+)><>Value", "kafka_$1_$2_$3", GAUGE, {"$4": "$5"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)><>Value", "kafka_$1_$2_$3", GAUGE),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+), (.+)=(.+), (.+)=(.+)><>Count", "kafka_$1_$2_$3_count", COUNTER, {"$4": "$5", "$6": "$7"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+), (.+)=(.*), (.+)=(.+)><>(\d+)thPercentile", "kafka_$1_$2_$3", GAUGE, {"$4": "$5", "$6": "$7", "quantile": "0.$8"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+), (.+)=(.+)><>Count", "kafka_$1_$2_$3_count", COUNTER, {"$4": "$5"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+), (.+)=(.*)><>(\d+)thPercentile", "kafka_$1_$2_$3", GAUGE, {"$4": "$5", "quantile": "0.$6"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)><>Count", "kafka_$1_$2_$3_count", COUNTER),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)><>(\d+)thPercentile", "kafka_$1_$2_$3", GAUGE, {"quantile": "0.$4"}),
)

# Rules of the rebalancing service.
REBALANCER_RULES: tuple[Rule, ...] = (
    Rule(r"kafka.cruisecontrol<name=(.+)><>(\w+)", "kafka_cruisecontrol_$1_$2", GAUGE),
)


def bean_text(domain: Column, properties: Column, attribute: Column, keys: Column | None = None) -> Column:
    """The text rules are matched against, up to the value: ``domain<properties><keys>attribute``."""
    return F.concat(
        domain, F.lit("<"), properties, F.lit("><"), F.lit("") if keys is None else keys, F.lit(">"), attribute
    )


_PIECES = "ARRAY<STRUCT<text: STRING, group: INT>>"
_RULE_TYPE = (
    f"STRUCT<pattern: STRING, groups: INT, kind: STRING, name: {_PIECES}, "
    f"labels: ARRAY<STRUCT<key: {_PIECES}, value: {_PIECES}>>>"
)


def _pieces(template: str) -> list[dict]:
    """A template as texts and numbers of groups, in order."""
    parts = re.split(r"\$(\d+)", template)
    return [{"text": p, "group": 0} if i % 2 == 0 else {"text": "", "group": int(p)} for i, p in enumerate(parts)]


def _rule_table(rules: Sequence[Rule]) -> Column:
    """The rules as one constant, so that the plan does not hold an expression for each of them."""
    rows = [
        {
            "pattern": r.pattern,
            "groups": re.compile(r.pattern).groups,
            "kind": r.kind,
            "name": _pieces(r.name),
            "labels": [{"key": _pieces(k), "value": _pieces(v)} for k, v in r.labels.items()],
        }
        for r in rules
    ]
    return F.from_json(F.lit(json.dumps(rows)), f"ARRAY<{_RULE_TYPE}>")


def _fill(pieces: Column, groups: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.get(groups, p["group"] - 1), p["text"])), "")


def _safe(name: Column) -> Column:
    """Characters a metric or label name cannot hold become one underscore."""
    return F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9:_]", "_"), "__+", "_")


def name_rows(df: DataFrame, rules: Sequence[Rule] = BROKER_RULES, text: str = "bean") -> DataFrame:
    """Add ``metric``, ``labels`` and ``kind`` row by row; rows that no rule matches are dropped.

    The first matching rule is found once. Its groups then fill the templates of
    the name and the labels. Names are in lower case; a label without a name or
    a value is left out.
    """
    column, groups, rule = F.col(text), F.col("groups"), F.col("rule")
    number = F.lit(None).cast("int")
    for place in range(len(rules), 0, -1):
        number = F.when(column.rlike(rules[place - 1].pattern), F.lit(place)).otherwise(number)
    most = max(re.compile(r.pattern).groups for r in rules)
    found = [
        F.when(rule["groups"] >= i, F.call_function("regexp_extract", column, rule["pattern"], F.lit(i)))
        for i in range(1, most + 1)
    ]
    filled = F.transform(
        rule["labels"],
        lambda pair: F.struct(
            _safe(_fill(pair["key"], groups)).alias("key"), _fill(pair["value"], groups).alias("value")
        ),
    )
    ruled = (
        df.withColumn("number", number)
        .where(F.col("number").isNotNull())
        .withColumn("rule", F.element_at(_rule_table(rules), F.col("number")))
        .withColumn("groups", F.array(*found) if found else F.array().cast("array<string>"))
    )
    return ruled.select(
        *df.columns,
        F.lower(_safe(_fill(rule["name"], groups))).alias("metric"),
        F.map_from_entries(F.filter(filled, lambda pair: (pair["key"] != "") & (pair["value"] != ""))).alias("labels"),
        rule["kind"].alias("kind"),
    )


def normalize(df: DataFrame, rules: Sequence[Rule] = BROKER_RULES, bean: str = "bean") -> DataFrame:
    """``name_rows`` for a table in which the same beans occur again and again.

    Some thirty patterns per row are far dearer than a scan. A name does not
    depend on the value, so the patterns run once per distinct bean, and a join
    brings the names back. Adaptive execution sends the names to all tasks when
    they measure small, and otherwise splits beans that occur very often.
    ``bean`` is the text without a value.
    """
    # The rules see a text that goes on with ": " and the value. It depends on the
    # count, or the test for a matching rule would move below the aggregate and
    # run on every row.
    beans = df.groupBy(bean).agg(F.count("*").alias("seen"))
    beans = beans.withColumn("text", F.when(F.col("seen") > 0, F.concat(F.col(bean), F.lit(": ")))).drop("seen")
    return df.join(name_rows(beans, rules, "text").drop("text"), bean)
