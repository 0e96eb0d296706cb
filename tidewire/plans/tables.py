"""Layouts of the event tables and the shared dead-letter table.

A target is either a folder (parquet) or the name of a v2 catalog table. Both
have the same columns. A folder table carries its partition values as derived
columns; a catalog table uses partition transforms.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.plans import changes
from tidewire.sources import paths

# Partition values of dead-letter rows whose schema name is absent or unknown.
NO_SCHEMA = "__none__"
OTHER_SCHEMA = "__other__"
# Further partition columns of tables written in idempotent mode.
BATCH_PARTITIONS = ("query_id", "batch_id")
# Columns that tell the records of a topic apart.
COORDINATES = ("topic", "partition", "offset")


@dataclass(frozen=True)
class Layout:
    """Columns, required flags and partitioning of one kind of table.

    ``identity`` is the column partitioned by value, ``time`` the one
    partitioned by day. ``folder_key`` is the identity column as folder tables
    hold it.
    """

    columns: T.StructType
    identity: str
    time: str
    folder_key: str

    def with_coordinates(self) -> Layout:
        """The same with the coordinates of each record, which tell rows of a replay apart."""
        if set(COORDINATES) <= set(self.names):
            return self
        kinds = (T.StringType(), T.IntegerType(), T.LongType())
        fields = [(f.name, f.dataType, not f.nullable) for f in self.columns.fields]
        return replace(self, columns=_columns(*fields, *[(c, k, False) for c, k in zip(COORDINATES, kinds)]))

    @property
    def day(self) -> str:
        return f"{self.time}_day"

    @property
    def names(self) -> list[str]:
        return self.columns.names

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.columns.fields if not f.nullable]

    @property
    def partition_spec(self) -> list[tuple[str, str]]:
        return [(self.identity, "identity"), (self.day, "day")]

    @property
    def folder_partitions(self) -> list[str]:
        return [self.folder_key, self.day]

    @property
    def folder_schema(self) -> T.StructType:
        extra = [] if self.folder_key in self.names else [T.StructField(self.folder_key, T.StringType())]
        return T.StructType([*self.columns.fields, *extra, T.StructField(self.day, T.DateType())])


def _columns(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    """Columns as ``(name, type, required)``, with field ids from 1."""
    return T.StructType(
        [
            T.StructField(name, kind, not required, {"parquet.field.id": number})
            for number, (name, kind, required) in enumerate(fields, start=1)
        ]
    )


EVENTS = Layout(
    _columns(
        ("id", T.LongType(), True),
        ("datetime", T.TimestampType(), True),
        ("schema_name", T.StringType(), True),
        ("rawdata", T.BinaryType(), True),
    ),
    identity="schema_name",
    time="datetime",
    folder_key="schema_name",
)

# A rejected record may have no value at all, so ``rawdata`` may be NULL here.
# The schema name of a reject is whatever the sender wrote. Used as a folder
# name it could be empty, too long, or differ in every record, so folder tables
# partition by ``schema_key``: a known name, or one of the two values above.
REJECTS = Layout(
    _columns(
        ("failed_at", T.TimestampType(), True),
        ("schema_name", T.StringType(), False),
        ("rawdata", T.BinaryType(), False),
        ("reason", T.StringType(), True),
    ),
    identity="schema_name",
    time="failed_at",
    folder_key="schema_key",
)


def utc_day(moment: Column) -> Column:
    """Calendar day in UTC, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(moment) / F.lit(86400)).cast("int"))


def schema_key(name: Column, known: Sequence[str]) -> Column:
    return (
        F.when(name.isNull(), F.lit(NO_SCHEMA)).when(name.isin(*known), name).otherwise(F.lit(OTHER_SCHEMA))
    )


def is_folder(target: str) -> bool:
    return "/" in target


def conform(df: DataFrame, layout: Layout) -> DataFrame:
    """The declared columns in order.

    Fails at once on a missing or mistyped column. A NULL in a required column
    fails the write, as parquet itself would not.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in layout.columns.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns do not match the table: {', '.join(wrong)}")

    def column(field: T.StructField) -> Column:
        value = F.col(field.name)
        if not field.nullable:
            missing = F.raise_error(F.lit(f"{field.name} is required")).cast(field.dataType)
            value = F.when(value.isNull(), missing).otherwise(value)
        return value.alias(field.name, metadata=field.metadata)

    return df.select(*[column(f) for f in layout.columns.fields])


def with_partitions(df: DataFrame, layout: Layout, known: Sequence[str] = ()) -> DataFrame:
    if layout.folder_key not in layout.names:
        df = df.withColumn(layout.folder_key, schema_key(F.col(layout.identity), known))
    return df.withColumn(layout.day, utc_day(F.col(layout.time)))


def append(
    df: DataFrame,
    target: str,
    layout: Layout,
    known: Sequence[str] = (),
    batch: tuple[str, int] | None = None,
    rebalance: bool = False,
    counted: dict[str, Column] | None = None,
) -> dict[str, int]:
    """Append rows; what the aggregates ``counted`` give over the rows that were written.

    With ``batch = (query id, batch id)`` the rows of one micro-batch go to
    partitions of their own, which a replay of that batch overwrites. In a catalog
    table, whose commits are whole, rows whose coordinates it has are left out instead.
    ``rebalance`` shuffles by partition value first, which keeps a backfill of
    many days from writing one small file per task and day; large days are
    still split over tasks.

    Rows are counted behind the last shuffle, so a task that runs again counts once.
    """
    each = [column.alias(name) for name, column in (counted or {}).items()]
    if not is_folder(target):
        if batch is not None:
            return _append_once(conform(df, layout.with_coordinates()), target, layout, each)
        rows, found = _counting(conform(df, layout), each)
        rows.writeTo(target).append()
        return found()
    rows = with_partitions(conform(df, layout), layout, known)
    keys = layout.folder_partitions
    if rebalance:
        rows = rows.hint("rebalance", *[F.col(k) for k in keys])
    rows, found = _counting(rows, each)
    if batch is None:
        rows.write.mode("append").partitionBy(*keys).parquet(target)
        return found()
    rows = rows.select("*", *[F.lit(v).alias(c) for c, v in zip(BATCH_PARTITIONS, batch)])
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys, *BATCH_PARTITIONS)
        .parquet(target)
    )
    return found()


def _counting(rows: DataFrame, each: list[Column]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    if not each:
        return rows, dict
    seen = Observation()
    return rows.observe(seen, *each), lambda: seen.get


def _append_once(rows: DataFrame, target: str, layout: Layout, each: list[Column]) -> dict[str, int]:
    """Add the rows whose coordinates the table does not have, by MERGE."""
    # Both sides of a MERGE read its source, so the rows are counted on their own.
    found = rows.agg(*each).first().asDict() if each else {}
    with changes.view_of(rows) as view:
        rows.sparkSession.sql(changes.append_once_sql(target, view, layout.with_coordinates().names, COORDINATES))
    return found


def open_table(spark: SparkSession, target: str) -> None:
    """Make a folder table readable before its first row."""
    if is_folder(target):
        paths.make_dir(spark, target)


def read(spark: SparkSession, layout: Layout, *targets: str) -> DataFrame:
    """Rows of one or more tables of the same layout.

    The partition columns stay available for pruning, which works through the
    union of several tables.
    """

    def one(target: str) -> DataFrame:
        if is_folder(target):
            return spark.read.schema(layout.folder_schema).parquet(target)
        return with_partitions(spark.table(target).select(*layout.names), layout)

    frames = [one(t) for t in targets]
    return reduce(DataFrame.unionByName, frames)


def after(df: DataFrame, layout: Layout, moment: Column) -> DataFrame:
    """Rows later than ``moment``; the day condition lets the scan skip folders."""
    return df.where((F.col(layout.day) >= utc_day(moment)) & (F.col(layout.time) > moment))


def of_schema(df: DataFrame, layout: Layout, name: str) -> DataFrame:
    """Rows of one message type; the key condition lets the scan skip folders."""
    rows = df.where(F.col(layout.identity) == F.lit(name))
    if layout.folder_key == layout.identity:
        return rows
    return rows.where(F.col(layout.folder_key).isin(name, OTHER_SCHEMA))


def moment(as_of: datetime | Column | None) -> Column:
    """The instant a report looks back from; now unless one is given."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


# Row-level changes rewrite files.
COPY_ON_WRITE = {
    "write.merge.mode": "copy-on-write",
    "write.update.mode": "copy-on-write",
    "write.delete.mode": "copy-on-write",
}


def create_sql(table: str, layout: Layout, provider: str = "iceberg") -> str:
    """DDL of a v2 catalog table."""
    columns = ",\n  ".join(
        f"{f.name} {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}"
        for f in layout.columns.fields
    )
    properties = ", ".join(f"'{k}'='{v}'" for k, v in COPY_ON_WRITE.items())
    return (
        f"CREATE TABLE IF NOT EXISTS {table} (\n  {columns}\n)\nUSING {provider}\n"
        f"PARTITIONED BY ({layout.identity}, days({layout.time}))\nTBLPROPERTIES ({properties})"
    )
