"""Keyed records with headers, from a message broker or a folder of parquet files.

The folder form holds one sub-folder per topic (``topic=<name>``), so that a
stream that subscribes to one topic lists and reads nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.registry import StreamSpec
from tidewire.sources.paths import ANY_AGE
from tidewire.sources import paths

HEADERS_TYPE = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
)

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", HEADERS_TYPE),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

STARTING = ("earliest", "latest")

_LISTED = "path string, written timestamp"


@dataclass(frozen=True)
class FolderRecords:
    """Records kept as parquet below ``root``.

    A micro-batch is bounded, by files or else by bytes, so a large backlog is
    drained in steps that each commit.

    A folder has no notion of "latest". So a stream that starts there first lists what
    the folder holds, beside its checkpoint, and leaves these files out whenever it
    runs; scans skip them by name. The list counts once it is whole: a job that
    broke off before makes it anew. Only files of the last ``grace`` before the newest one are
    listed, all older ones are left out; so a file must not take that long to appear.
    """

    root: str
    starting: str = "earliest"
    files_per_trigger: int | None = None
    bytes_per_trigger: int = 1 << 40
    grace: str = "1 day"

    def __post_init__(self) -> None:
        _check_starting(self.starting)

    def folder(self, topic: str) -> str:
        return f"{self.root}/topic={topic}"

    def stream(self, spark: SparkSession, spec: StreamSpec) -> DataFrame:
        reader = spark.readStream.schema(RECORD_SCHEMA).options(**ANY_AGE)
        if self.files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.files_per_trigger)
        else:
            reader = reader.option("maxBytesPerTrigger", self.bytes_per_trigger)
        rows = reader.parquet(self.folder(spec.topic))
        if self.starting == "latest":
            rows = rows.where(self._is_new(spark, spec))
        return self._with_topic(rows, spec.topic)

    def _is_new(self, spark: SparkSession, spec: StreamSpec) -> Column:
        seed = f"{spec.checkpoint.rstrip('/')}.seed"
        if not paths.exists(spark, f"{seed}/_SUCCESS"):
            if paths.exists(spark, spec.checkpoint):
                return F.lit(True)  # a stream that began without a list
            self._list(spark, self.folder(spec.topic)).coalesce(1).write.mode("overwrite").parquet(seed)
        listed = spark.read.schema(_LISTED).parquet(seed)
        newest = listed.agg((F.max("written") - F.expr(f"interval {self.grace}")).alias("since")).first()["since"]
        if newest is None:
            return F.lit(True)
        names = [r["path"] for r in listed.where(F.col("written") >= F.lit(newest)).select("path").collect()]
        return (F.col("_metadata.file_modification_time") >= F.lit(newest)) & ~F.col("_metadata.file_path").isin(names)

    def _list(self, spark: SparkSession, folder: str) -> DataFrame:
        """The files of a folder and when they were written."""
        if not paths.children(spark, folder):
            return spark.createDataFrame([], _LISTED)
        return spark.read.format("binaryFile").load(folder).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("written")
        )

    def batch(self, spark: SparkSession, spec: StreamSpec) -> DataFrame:
        return self._with_topic(spark.read.schema(RECORD_SCHEMA).parquet(self.folder(spec.topic)), spec.topic)

    @staticmethod
    def _with_topic(df: DataFrame, topic: str) -> DataFrame:
        return df.withColumn("topic", F.lit(topic)).select(*RECORD_SCHEMA.names)


@dataclass(frozen=True)
class BrokerRecords:
    """Records of a Kafka cluster (needs the spark-sql-kafka package).

    ``records_per_task`` splits a hot topic partition over several tasks;
    ``offsets_per_trigger`` bounds a micro-batch.
    """

    servers: str
    starting: str = "earliest"
    records_per_task: int | None = None
    offsets_per_trigger: int | None = 1_000_000_000
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _check_starting(self.starting)

    def options(self, spec: StreamSpec) -> dict[str, str]:
        options = {
            "kafka.bootstrap.servers": self.servers,
            "subscribe": spec.topic,
            "startingOffsets": self.starting,
            "includeHeaders": "true",
        }
        if self.records_per_task:
            options["maxRecordsPerPartition"] = str(self.records_per_task)
        if self.offsets_per_trigger:
            options["maxOffsetsPerTrigger"] = str(self.offsets_per_trigger)
        return {**options, **self.extra}

    def stream(self, spark: SparkSession, spec: StreamSpec) -> DataFrame:
        return spark.readStream.format("kafka").options(**self.options(spec)).load().select(*RECORD_SCHEMA.names)

    def batch(self, spark: SparkSession, spec: StreamSpec) -> DataFrame:
        return spark.read.format("kafka").options(**self.options(spec)).load().select(*RECORD_SCHEMA.names)


def placed(records: DataFrame, offset: Column) -> DataFrame:
    """Records as a broker with one partition would store them now."""
    return records.withColumns(
        {"partition": F.lit(0), "offset": offset.cast("bigint"), "timestamp": F.current_timestamp()}
    ).select(*RECORD_SCHEMA.names)


def write_folder(records: DataFrame, root: str) -> None:
    """Append records below ``root``, one sub-folder per topic."""
    records.write.mode("append").partitionBy("topic").parquet(root)


def open_topic(spark: SparkSession, root: str, topic: str) -> None:
    """Make a topic folder, so that a stream can start before the first record."""
    paths.make_dir(spark, f"{root}/topic={topic}")


def write_broker(records: DataFrame, servers: str, **extra: str) -> None:
    """Send records to the topic each row names (needs the spark-sql-kafka package)."""
    options = {"kafka.bootstrap.servers": servers, "includeHeaders": "true", **extra}
    records.select("key", "value", "headers", "topic").write.format("kafka").options(**options).save()


def _check_starting(starting: str) -> None:
    if starting not in STARTING:
        raise ValueError(f"starting must be one of {STARTING}, not {starting!r}")
