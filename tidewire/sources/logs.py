"""Container log files: text folders in, log lines out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.containers import parse_line
from tidewire.session import ship, work_dir
from tidewire.sources.paths import ANY_AGE


def _located(lines: DataFrame) -> DataFrame:
    """The file of each line, and the split of the file it was read from."""
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def parsed(raw: DataFrame) -> DataFrame:
    """``path, block, line_no, ts, stream, partial, log`` of raw lines.

    A split is read in order by one task, so ``line_no`` orders its lines.
    """
    return fields(raw.withColumn("line_no", F.monotonically_increasing_id()))


def fields(raw: DataFrame) -> DataFrame:
    """``ts, stream, partial, log`` in place of ``value``; a line of unknown form keeps its text."""
    found = raw.withColumn("line", parse_line(F.col("value")))
    return found.select(
        *[c for c in raw.columns if c != "value"],
        F.col("line.ts").alias("ts"),
        F.coalesce("line.stream", F.lit("stdout")).alias("stream"),
        F.coalesce("line.partial", F.lit(False)).alias("partial"),
        F.when(F.col("line").isNull(), F.col("value")).otherwise(F.col("line.log")).alias("log"),
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines of all files below a folder."""
    return parsed(_located(spark.read.text(folder, recursiveFileLookup=True)))


def tail(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of raw lines; ``parsed`` is for its micro-batches.

    A file is read once, when it appears, so logs should arrive as rotated,
    finished files; ``appended`` is for files that still grow.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true").options(**ANY_AGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _located(reader.text(folder))


def collect_new(
    spark: SparkSession, folder: str, target: str, checkpoint: str, files_per_trigger: int | None = None
) -> None:
    """Append the lines of all files not read before, then stop.

    The checkpoint remembers the files that were read. Each micro-batch has a
    partition of its own, so one that runs again replaces what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            parsed(batch)
            .withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(target)
        )

    (
        tail(spark, folder, files_per_trigger)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
        .awaitTermination()
    )


#: First bytes of a file that tell it from others, wherever it is moved.
HEAD_BYTES = 1024
#: Bytes of a file that one row stands for.
RANGE_BYTES = 32 << 20
POSITIONS = "path string, position long, head_bytes int, head binary, was string"

#: Opens a file of any store at a URI; gives ``read_at(length, position)``.
Opener = Callable[[str], object]


def open_uri(uri: str):
    """A file of a store that Arrow knows: local, HDFS, S3, GCS, Azure."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _heads(opener: Opener):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                with opener(path) as file:
                    heads.append(bytes(file.read_at(min(HEAD_BYTES, size), 0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("size"), pa.array(heads, pa.binary())], names=["path", "size", "bytes"]
            )

    return read


def whole_lines(file, start: int, low: int, high: int, size: int, step: int = 1 << 20) -> tuple[int, bytes]:
    """(place, bytes) of the whole lines that begin in [low, high), where ``start`` begins a line.

    The last of them is read to its end, but not beyond ``size``; without its line feed it is left out.
    """
    # What stands before ``low`` says whether a line begins there.
    at = low if low == start else low - 1
    parts = [bytes(file.read_at(min(high, size) - at, at))]
    if low != start:
        cut = parts[0].find(b"\n") + 1
        if not cut or at + cut >= high:
            return high, b""
        at, parts[0] = at + cut, parts[0][cut:]
    end = min(high, size)
    while parts[-1] and not parts[-1].endswith(b"\n") and end < size:
        more = bytes(file.read_at(min(step, size - end), end))
        end += len(more)
        parts.append(more[: more.find(b"\n") + 1] if b"\n" in more else more)
    data = b"".join(parts)
    return at, data[: data.rfind(b"\n") + 1]


def _lines(opener: Opener):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opener(row["path"]) as file:
                    at, data = whole_lines(file, row["start"], row["low"], row["high"], row["size"])
                ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                if not len(ends):
                    continue
                begins = np.append(0, ends[:-1] + 1)
                # Without the line feeds a line ends as many bytes earlier as there were lines before.
                offsets = np.append(0, ends - np.arange(len(ends))).astype(np.int32)
                text = pa.py_buffer(data.replace(b"\n", b""))
                values = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), text)
                for low in range(0, len(ends), 8192):
                    part = slice(low, low + 8192)
                    n = len(ends[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["path"]] * n, pa.string()),
                            pa.array(at + begins[part], pa.int64()),
                            pa.array(ends[part] + 1 - begins[part], pa.int64()),
                            values.slice(low, n),
                        ],
                        names=["path", "line_no", "bytes", "value"],
                    )

    return read


def appended(
    spark: SparkSession,
    folder: str,
    before: DataFrame,
    files: str = "*.log",
    staged: str | None = None,
    opener: Opener = open_uri,
    range_bytes: int = RANGE_BYTES,
) -> tuple[DataFrame, DataFrame] | None:
    """(lines, positions): what was appended to the files of a folder; None when no file changed.

    ``before`` is what ``positions`` was the last time: the bytes read of each ``path``, and a
    digest of its first bytes. Lines have ``path, line_no, value``; ``line_no`` is the
    byte at which a line begins. A last line without its line feed is left for the next time.

    Reading goes on at the byte where it ended: the bytes behind it are cut into ranges of
    ``range_bytes``, which tasks read on their own, so a large file is not read by one task and
    nothing is read again. Lines are written to ``staged``, so each byte is read once.

    A file is known by its first bytes. Under another name it goes on where it was, and
    ``positions`` says in ``was`` how it was called; a file of other first bytes, or shorter
    than what was read, began anew, and what had its name before is looked for among the
    new names. Files of the same first bytes are told apart by their names alone.
    """
    ship(spark)
    staged = staged or work_dir(spark, "appended")
    for name, kind in (("head_bytes", "int"), ("head", "binary")):
        if name not in before.columns:
            before = before.withColumn(name, F.lit(None).cast(kind))
    before = before.select("path", "position", "head_bytes", "head")
    listed = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup="true", pathGlobFilter=files)
        .load(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    )
    since = listed.join(before, "path", "left")
    changed = since.where(F.col("size") != F.coalesce("position", F.lit(0)))
    heads = f"{staged}/heads"
    opened = changed.select("path", "size").repartition(spark.sparkContext.defaultParallelism)
    opened.mapInArrow(_heads(opener), "path string, size long, bytes binary").write.mode("overwrite").parquet(heads)
    heads = spark.read.schema("path string, size long, bytes binary").parquet(heads)
    if not heads.take(1):
        return None
    starts = f"{staged}/starts"
    _starts(listed, heads, before).write.mode("overwrite").parquet(starts)
    starts = spark.read.schema("path string, size long, position long, was string, bytes binary").parquet(starts)
    low = F.explode(F.sequence("position", F.col("size") - 1, F.lit(range_bytes).cast("long")))
    ranges = starts.where(F.col("size") > F.col("position")).select("path", "size", F.col("position").alias("start"), low.alias("low"))
    ranges = ranges.withColumn("high", F.least(F.col("low") + range_bytes, "size"))
    # One task for each range, or some where there are very many.
    tasks = min(max(ranges.count(), 1), 100_000)
    read = ranges.repartition(tasks, "path", "low").mapInArrow(_lines(opener), "path string, line_no long, bytes long, value string")
    read.write.mode("overwrite").parquet(f"{staged}/lines")
    lines = spark.read.schema("path string, line_no long, bytes long, value string").parquet(f"{staged}/lines")
    reached = lines.groupBy("path").agg(F.max(F.col("line_no") + F.col("bytes")).alias("reached"))
    position = F.coalesce("reached", "position")
    known = F.least(F.lit(HEAD_BYTES), position).cast("int")
    read_on = starts.join(reached, "path", "left").select(
        "path", position.alias("position"), known.alias("head_bytes"), _head(F.col("bytes"), known).alias("head"), "was"
    )
    still = since.join(heads.select("path"), "path", "left_anti")
    kept = still.select("path", "position", "head_bytes", "head", F.when(F.col("position").isNotNull(), F.col("path")).alias("was"))
    # The folder is listed once: positions are what it was then.
    known = read_on.unionByName(kept.where(F.col("position").isNotNull()))
    known.write.mode("overwrite").parquet(f"{staged}/positions")
    return lines.select("path", "line_no", "value"), spark.read.schema(POSITIONS).parquet(f"{staged}/positions")


def _head(data: Column, size: Column) -> Column:
    return F.unhex(F.sha2(F.substring(data, F.lit(1), size), 256))


def _starts(listed: DataFrame, heads: DataFrame, before: DataFrame) -> DataFrame:
    """path, size, position, was, bytes: where reading of each changed file goes on, and its name before."""
    old = before.withColumnsRenamed({"path": "was"})
    own = heads.join(old, heads["path"] == old["was"], "left")
    # Positions without a digest were taken before files were known by one.
    same = (F.col("size") >= F.col("position")) & F.coalesce(
        F.col("head_bytes").isNull() | (_head(F.col("bytes"), F.col("head_bytes")) == F.col("head")), F.lit(False)
    )
    going_on = own.where(same).select("path", "size", "position", "was", "bytes")
    others = heads.join(going_on.select("path"), "path", "left_anti")
    # Files whose names are gone or have another file now.
    unchanged = listed.join(before, "path").where(F.col("size") == F.col("position")).select(F.col("path").alias("was"))
    there = unchanged.unionAll(going_on.select("was"))
    lost = old.where(F.col("head_bytes") > 0).join(there, "was", "left_anti")
    # Lengths of heads are numbers up to ``HEAD_BYTES``, mostly that one.
    lengths = sorted(r["head_bytes"] for r in lost.select("head_bytes").distinct().collect())
    tried = others.withColumn("head_bytes", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")))
    tried = tried.where(F.col("size") >= F.col("head_bytes")).withColumn("head", _head(F.col("bytes"), F.col("head_bytes")))
    met = tried.join(lost, ["head_bytes", "head"]).where(F.col("size") >= F.col("position"))
    # One name for each file, and one file for each name.
    named = met.groupBy("was").agg(F.min("path").alias("path"), F.first("position").alias("position"))
    moved = named.groupBy("path").agg(F.max(F.struct("position", "was")).alias("of")).select("path", "of.position", "of.was")
    begun = others.join(moved, "path", "left").select(
        "path", "size", F.coalesce("position", F.lit(0)).alias("position"), "was", "bytes"
    )
    return going_on.unionByName(begun)


def write_streams(logs: DataFrame, target: str, prefix: str = "", run: int | None = None) -> None:
    """Append logs, one folder per day and namespace; ``log_stream`` names the stream.

    Pods come and go, so a folder for each would leave very many small files. Their lines lie
    together in the files instead, and a scan for one pod passes over the row groups of others.
    With ``run`` each run has partitions of its own, which it replaces when it is done again.
    """
    named = logs.withColumn("log_stream", F.concat(F.lit(prefix), F.regexp_extract("path", r"([^/]+?)(\.log)?$", 1)))
    keys = ["day", "namespace"]
    named = named.withColumn("day", F.to_date("ts")).hint("rebalance", *map(F.col, keys))
    if run is not None:
        named, keys = named.withColumn("run", F.lit(run)), [*keys, "run"]
    rows = named.sortWithinPartitions(*keys, "pod_name", "log_stream", "ts").write.partitionBy(*keys)
    if run is None:
        rows.mode("append").parquet(target)
    else:
        rows.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)
