"""Aggregation of evaluated series over labels, and label lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import entries, label


def _keys(series: DataFrame, by: Sequence[str]) -> list[Column]:
    return [F.col(name) if name in series.columns else label(name).alias(name) for name in by]


#: Places behind the point that sums of doubles keep.
EXACT = "decimal(38,12)"


def exact_sum(value: Column) -> Column:
    """The sum of doubles, the same in whatever order they are added.

    They are added as decimals, so a small one beside large ones is not lost. Where one of
    them has no such decimal (not a number, infinite, beyond 26 digits) they are added as they are.
    """
    exact = value.try_cast(EXACT)
    return F.coalesce(F.when(F.count(value) == F.count(exact), F.try_sum(exact).cast("double")), F.sum(value))


def sum_by(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum per evaluation time and label values."""
    return series.groupBy("ts", *_keys(series, by)).agg(exact_sum(F.col("value")).alias("value"))


def count_by(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return series.groupBy("ts", *_keys(series, by)).agg(F.count("value").cast("double").alias("value"))


def scaled(series: DataFrame, factor: float) -> DataFrame:
    return series.withColumn("value", F.col("value") * F.lit(factor))


def below(series: DataFrame, bound: float) -> DataFrame:
    """1.0 where the value is below the bound, else 0.0."""
    return series.withColumn("value", (F.col("value") < F.lit(bound)).cast("double"))


def label_values(samples: DataFrame, name: str) -> DataFrame:
    """Distinct non-empty values of a label, sorted."""
    value = label(name).alias("value")
    return samples.select(value).where(F.col("value") != "").distinct().orderBy("value")


def distinct_maps(samples: DataFrame) -> DataFrame:
    """``metric, labels, seen``: the label maps that samples have, as they have them, and how many.

    A series has several rows if its labels come in several orders. They are put in order
    behind this, where they are few; for a sample that costs more than anything else.
    """
    parts = {"names": F.map_keys("labels"), "held": F.map_values("labels")}
    found = samples.groupBy("metric", *[c.alias(n) for n, c in parts.items()]).agg(F.count("*").alias("seen"))
    # The map depends on the count, or it would be made on every sample.
    return found.select("metric", F.when(F.col("seen") > 0, F.map_from_arrays("names", "held")).alias("labels"), "seen")


def series_text() -> Column:
    """``metric{a="x",b="y"}`` of a series with its labels as ``pairs``."""
    pairs = F.transform("pairs", lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.concat(F.col("metric"), F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def captured_values(samples: DataFrame, pattern: str) -> DataFrame:
    """Distinct first captures of a pattern over ``metric{a="x",b="y"}``, sorted."""
    # Samples are reduced to series first. The text depends on the count, or the
    # match would move below the aggregate and run on every sample.
    series = distinct_maps(samples).groupBy("metric", entries("labels").alias("pairs")).agg(F.sum("seen").alias("seen"))
    named = series.select(F.when(F.col("seen") > 0, series_text()).alias("text"))
    found = named.where(F.col("text").rlike(pattern)).select(F.regexp_extract("text", pattern, 1).alias("value"))
    return found.distinct().orderBy("value")


def top_rows(table: DataFrame, column: int, size: int = 10) -> DataFrame:
    """First page of a table, by one column descending; the other columns break ties."""
    main = table.columns[column]
    rest = [F.col(c) for c in table.columns if c != main]
    return table.orderBy(F.col(main).desc(), *rest).limit(size)
