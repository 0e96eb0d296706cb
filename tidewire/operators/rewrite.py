"""Row-level changes of tables: by rewriting the partitions they touch, or by SQL on a catalog.

A folder table is changed in steps. The new content of the touched partitions is
written beside the table, since a plan must not overwrite what it reads. Then an intent
is recorded in the table's folder: where the content lies, and which partitions will have
no rows any more. Then the content replaces the partitions, the empty ones go, and the
intent is removed. What is recorded can be applied any number of times with the same
end, so a change that broke off behind its intent is finished by ``resume``, and one that
broke off before it has changed nothing. Every change begins with ``resume``.

A table of a v2 catalog is changed by one MERGE, UPDATE or DELETE, which its commits
make whole; conditions and values are then SQL texts.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.plans import changes as sql
from tidewire.plans import tables
from tidewire.plans.tables import Layout
from tidewire.session import work_dir
from tidewire.sources import paths

#: Folder of the intent below the table; readers pass over names that begin so.
INTENT = "_rewrite"


def _keys(table: DataFrame, layout: Layout) -> list[str]:
    """Partition columns, with those of single micro-batches where the table has them."""
    return layout.folder_partitions + [c for c in tables.BATCH_PARTITIONS if c in table.columns]


def _text(value: str | Column) -> str:
    if not isinstance(value, str):
        raise ValueError("for a table of a catalog give conditions and values as SQL texts")
    return value


def _column(value: str | Column) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def _folder_name(keys: Sequence[str]) -> Column:
    """A partition as one text, from its columns alone."""
    return F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])


def _partitions(df: DataFrame, keys: list[str]) -> set[str]:
    """Distinct partitions: as many as the table has folders at most,
    which is what the driver holds anyway to plan a scan."""
    return {r["p"] for r in df.select(_folder_name(keys).alias("p")).distinct().collect()}


def _inside(found: set[str], keys: list[str]) -> Column:
    """Condition on the partition columns alone: one look into a set for each folder, and the
    scan skips the others."""
    return _folder_name(keys).isin(sorted(found))


def _new_rows(rows: DataFrame, layout: Layout, keys: list[str]) -> DataFrame:
    """Rows to add, in partitions that no micro-batch will overwrite."""
    rows = tables.with_partitions(tables.conform(rows, layout), layout)
    values = dict(zip(tables.BATCH_PARTITIONS, (F.lit("rewrite"), F.lit(0))))
    return rows.select("*", *[values[k].alias(k) for k in keys if k in values])


def _staged(spark: SparkSession, rows: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """``rows`` written below the shared folder and read back, and where."""
    path = work_dir(spark, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def _intent(spark: SparkSession, target: str) -> dict | None:
    """What a change has recorded and not yet finished."""
    if not paths.exists(spark, f"{target}/{INTENT}/_SUCCESS"):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{target}/{INTENT}").collect()))


def _record(spark: SparkSession, target: str, intent: dict) -> None:
    """The intent counts once its folder has the mark of a finished write."""
    rows = spark.createDataFrame([(json.dumps(intent),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(f"{target}/{INTENT}")


def _overwrite(spark: SparkSession, target: str, intent: dict) -> None:
    keys = intent["keys"]
    staged = spark.read.schema(T.StructType.fromJson(intent["schema"])).parquet(intent["staged"])
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(target)


def _drop_empty(spark: SparkSession, target: str, intent: dict) -> None:
    # Overwriting leaves a partition alone when it has no rows any more.
    for folder in intent["emptied"]:
        paths.drop_dir(spark, f"{target}/{folder}")


def _forget(spark: SparkSession, target: str, intent: dict) -> None:
    paths.drop_dir(spark, f"{target}/{INTENT}")


def _clean(spark: SparkSession, target: str, intent: dict) -> None:
    paths.drop_dir(spark, intent["staged"])


#: What follows an intent, each step repeatable.
STEPS = (_overwrite, _drop_empty, _forget, _clean)


def resume(spark: SparkSession, target: str) -> bool:
    """Finish a change that broke off; whether there was one."""
    intent = _intent(spark, target)
    if intent is None:
        return False
    for step in STEPS:
        step(spark, target, intent)
    return True


def _directory(partition: str, keys: list[str]) -> str:
    values = partition.split("/", len(keys) - 1)
    return "/".join(f"{k}={paths.escaped(v)}" for k, v in zip(keys, values, strict=True))


def _replace(spark: SparkSession, target: str, touched: set[str], content: DataFrame, keys: list[str]) -> None:
    staged_path = work_dir(spark, "staged")
    content.hint("rebalance", *[F.col(k) for k in keys]).write.partitionBy(*keys).parquet(staged_path)
    # Types of partition columns are read from the names of their folders, so they are given.
    names = [*[c for c in content.columns if c not in keys], *keys]
    staged = spark.read.schema(content.select(*names).schema).parquet(staged_path)
    intent = {
        "staged": staged_path,
        "schema": staged.schema.jsonValue(),  # with the ids of its fields
        "keys": keys,
        "emptied": sorted(_directory(p, keys) for p in touched - _partitions(staged, keys)),
    }
    _record(spark, target, intent)
    for step in STEPS:
        step(spark, target, intent)


def delete_where(spark: SparkSession, target: str, layout: Layout, condition: str | Column) -> None:
    """Delete the rows for which the condition is true."""
    if not tables.is_folder(target):
        spark.sql(sql.delete_sql(target, _text(condition)))
        return
    resume(spark, target)
    condition = _column(condition)
    table = tables.read(spark, layout, target)
    keys = _keys(table, layout)
    touched = _partitions(table.where(condition), keys)
    if touched:
        doomed = F.coalesce(condition, F.lit(False))
        _replace(spark, target, touched, table.where(_inside(touched, keys)).where(~doomed), keys)


def upsert(
    spark: SparkSession, target: str, layout: Layout, changes: DataFrame, key: Sequence[str] = ("schema_name", "id")
) -> None:
    """Replace rows with the same key, add the others.

    A changed row may move to another day, so the partitions that hold old
    versions are found by key, reading only the key columns. The key must be
    unique within the changes, which are written once, as they are read several times.
    """
    key = list(key)
    changes, given = _staged(spark, tables.conform(changes, layout), "changes")
    twice = changes.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        paths.drop_dir(spark, given)
        raise ValueError(f"more than one change for {tuple(twice[0][k] for k in key)}")
    if not tables.is_folder(target):
        with sql.view_of(changes) as view:
            spark.sql(sql.upsert_sql(target, view, layout.names, key))
        paths.drop_dir(spark, given)
        return
    resume(spark, target)
    table = tables.read(spark, layout, target)
    keys = _keys(table, layout)
    new = _new_rows(changes, layout, keys)
    changed = changes.select(*key)
    held = table.select(*dict.fromkeys([*key, *keys])).join(changed, key, "left_semi")
    touched = _partitions(held, keys) | _partitions(new, keys)
    if touched:
        kept = table.where(_inside(touched, keys)).join(changed, key, "left_anti")
        _replace(spark, target, touched, kept.unionByName(new), keys)
    paths.drop_dir(spark, given)


def update_where(
    spark: SparkSession, target: str, layout: Layout, condition: str | Column, values: dict[str, str | Column]
) -> None:
    """Set columns of the rows for which the condition is true."""
    if not tables.is_folder(target):
        spark.sql(sql.update_sql(target, _text(condition), {c: _text(v) for c, v in values.items()}))
        return
    resume(spark, target)
    condition = _column(condition)
    table = tables.read(spark, layout, target)
    keys = _keys(table, layout)
    old = _partitions(table.where(condition), keys)
    if not old:
        return
    hit = F.coalesce(condition, F.lit(False))
    changed = table.where(_inside(old, keys)).where(hit).withColumns({c: _column(v) for c, v in values.items()})
    changed = _new_rows(changed.select(*layout.names), layout, keys)
    # A changed row may move to a day that other rows hold already.
    touched = old | _partitions(changed, keys)
    kept = table.where(_inside(touched, keys)).where(~hit)
    _replace(spark, target, touched, kept.unionByName(changed), keys)
