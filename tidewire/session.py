"""Session settings and the shared working folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Adaptive execution sizes the shuffles from measured bytes, so one setting
# serves both a laptop and a large cluster.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.scheduler.mode": "FAIR",
    # State of streams lies on the executors' disks, not on their heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Shuffles start with this many partitions and are merged to the advisory size.
# About the largest shuffle divided by that size; too few would spill.
SHUFFLE_START = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000"}

_local_roots: dict[str, str] = {}


def build_session(app_name: str = "tidewire", master: str | None = None, **conf: str) -> SparkSession:
    """One session shared by every stream of a job.

    Extra settings are given with ``__`` in place of dots, for example
    ``spark__sql__shuffle__partitions="2000"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    start = {} if (master or "").startswith("local") else SHUFFLE_START
    settings = {**CLUSTER_CONF, **start, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Without that setting a temporary folder is used, and only when the session
    runs on one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tidewire-")
    return _local_roots[app]


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/tidewire/{purpose}-{uuid.uuid4().hex[:12]}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """``spark``, whose Python workers have this library: as an archive in the shared folder, once per session."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        file = os.path.join(folder, name)
                        archive.write(file, os.path.relpath(file, os.path.dirname(root)))
        target = f"{work_dir(spark, 'library')}.zip"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(packed.getvalue())
        out.close()
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark
