"""Small file-system helpers over whatever store a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


# A file source passes over files dated so much before the newest one; no file may be.
ANY_AGE = {"maxFileAge": "36500d"}


# Fixed value: the printable characters that names of partition folders do not have as they are.
_ESCAPED = "\"#%'*/:=?\\\x7f{[]^"


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def escaped(value: str) -> str:
    """A partition value as it stands in the name of its folder."""
    if value == "\0":
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or c in _ESCAPED else c for c in value)


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _store(spark, path)
    return bool(store.exists(target))


def make_dir(spark: SparkSession, path: str) -> None:
    store, target = _store(spark, path)
    store.mkdirs(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none when it is absent."""
    store, target = _store(spark, path)
    return [found.getPath().getName() for found in store.listStatus(target)] if store.exists(target) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give a file another name; it replaces a file of that name."""
    store, end = _store(spark, target)
    _, begin = _store(spark, source)
    store.mkdirs(end.getParent())
    store.delete(end, False)
    store.rename(begin, end)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder and what is in it; no error when it is absent."""
    store, target = _store(spark, path)
    store.delete(target, True)
