"""Label maps: lookup, matchers, relabelling and legends."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(name: str, labels: str = "labels") -> Column:
    """Value of a label; a missing label is the empty string."""
    return F.coalesce(F.element_at(F.col(labels), name), F.lit(""))


@dataclass(frozen=True)
class Matcher:
    """One condition on a label: ``=``, ``!=``, ``=~`` or ``!~`` (full match)."""

    label: str
    op: str
    value: str

    def __post_init__(self) -> None:
        if self.op not in ("=", "!=", "=~", "!~"):
            raise ValueError(f"unknown matcher {self.op!r}")

    def condition(self, labels: str = "labels") -> Column:
        have = label(self.label, labels)
        if self.op == "=":
            return have == F.lit(self.value)
        if self.op == "!=":
            return have != F.lit(self.value)
        hit = F.lit(True) if self.value == ".*" else have.rlike(f"^(?s:{self.value})$")
        return hit if self.op == "=~" else ~hit


def matches(matchers: Sequence[Matcher], labels: str = "labels") -> Column:
    return reduce(lambda a, m: a & m.condition(labels), matchers, F.lit(True))


def entries(labels: Column | str) -> Column:
    """The labels as an array in key order: one comparable value per series."""
    return F.sort_array(F.map_entries(labels))


# Columns that name a series.
SERIES = ("series_a", "series_b")


def series_id() -> list[Column]:
    """Hash of the metric and all labels, whatever the order of the map."""
    pairs = entries("labels")
    return [
        F.xxhash64("metric", pairs).alias(SERIES[0]),
        F.xxhash64(F.lit("series"), pairs, "metric").alias(SERIES[1]),
    ]


def label_text(names: Sequence[str] | None = None, labels: str = "labels") -> Column:
    """``a=x,b=y`` over the given labels, or over all of them in key order."""
    if names is not None:
        parts = [F.concat(F.lit(f"{n}="), label(n, labels)) for n in names]
        return F.concat_ws(",", *parts)
    return F.array_join(F.transform(entries(labels), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def legend(template: str, labels: str = "labels") -> Column:
    """Text in which each ``{{label}}`` is replaced by its value."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    columns = [F.lit(p) if i % 2 == 0 else label(p, labels) for i, p in enumerate(parts)]
    return F.concat(*columns)


def labelmap(prefix: str, labels: Column | str = "labels", keep: str = "") -> Column:
    """Copy every label whose name starts with ``prefix`` to its name without it.

    Only names whose rest starts with ``keep`` are copied. The originals stay,
    unless a copy has the same name.
    """
    column = F.col(labels) if isinstance(labels, str) else labels
    start = prefix + keep
    chosen = F.map_filter(column, lambda k, v: k.startswith(start) & (F.length(k) > len(start)))
    copies = F.transform_keys(chosen, lambda k, v: F.substr(k, F.lit(len(prefix) + 1)))
    replaced = lambda k: k.startswith(keep) & (F.length(k) > len(keep)) & F.map_contains_key(column, F.concat(F.lit(prefix), k))
    return F.map_concat(F.map_filter(column, lambda k, v: ~replaced(k)), copies)


def replace_labels(targets: Mapping[str, str], labels: Column | str = "labels") -> Column:
    """Set each target label to the value of its source; an empty value removes the target.

    ``targets`` maps sources to targets. No source may be a target, so all are
    read from the labels as they came.
    """
    if set(targets) & set(targets.values()):
        raise ValueError("a source label is also a target")
    column = F.col(labels) if isinstance(labels, str) else labels
    pairs = [
        F.struct(F.lit(target).alias("key"), F.element_at(column, source).alias("value"))
        for source, target in targets.items()
    ]
    added = F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.coalesce(p["value"], F.lit("")) != ""))
    return F.map_concat(F.map_filter(column, lambda k, v: ~k.isin(*targets.values())), added)
