"""The container log job: appended lines in, whole messages of each pod out.

A run takes what was appended to the files since the run before it. What it leaves
behind is one folder: how far each file was read, and the messages whose last piece
has not come. The next run starts from the last folder that is whole, so a run that
broke off is done again and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import logs
from tidewire.sources import logs as log_source
from tidewire.sources import paths

_OPEN = "path string, stream string, line_no long, ts timestamp, log string, part long"
_MESSAGES = f"{_OPEN}, complete boolean"
_KEY = ["path", "stream", "line_no"]

# Bytes of one file that are put in order together.
CHUNK_BYTES = 64 << 20


def last_run(spark: SparkSession, state: str) -> int:
    """The number of the last run that came to its end, or -1."""
    begun = [int(name.removeprefix("run=")) for name in paths.children(spark, state) if name.startswith("run=")]
    return max((n for n in begun if paths.exists(spark, f"{state}/run={n}/done")), default=-1)


def _table(spark: SparkSession, schema: str, path: str | None) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def collect(
    spark: SparkSession, folder: str, target: str, state: str, pods: DataFrame, prefix: str = "", files: str = "*.log"
) -> int | None:
    """Write all messages finished since the last run; its number, or None when no file changed.

    ``pods`` is as for ``with_pod``. A message stays open until its last piece comes, under
    another name of its file, too. If its file began anew or is gone, what there is of it is
    written with ``complete`` false. Each appended byte is read once; where a run
    breaks off, what it wrote is replaced by the next one.
    """
    last = last_run(spark, state)
    known, now = (f"{state}/run={last}" if last >= 0 else None), f"{state}/run={last + 1}"
    before = _table(spark, log_source.POSITIONS, known and f"{known}/positions")
    waiting = _table(spark, _OPEN, known and f"{known}/open")
    found = log_source.appended(spark, folder, before, files, staged=f"{now}/appended")
    if found is None:
        return None
    lines, positions = found
    positions.write.mode("overwrite").parquet(f"{now}/positions")
    # Files that go on, by the names they had and have.
    named = _table(spark, log_source.POSITIONS, f"{now}/positions").where(F.col("was").isNotNull())
    named = named.select(F.col("path").alias("now"), F.col("was").alias("path"))
    carried = (
        waiting.join(named, "path")
        .withColumns({"path": F.col("now"), "line_no": F.col("line_no") + F.col("part"), "partial": F.lit(True)})
        .drop("now", "part")
    )
    pieces = log_source.fields(lines).unionByName(carried)
    joined = logs.join_partials(pieces, F.floor(F.col("line_no") / CHUNK_BYTES), staged=f"{now}/pieces")
    joined.select(*_table(spark, _MESSAGES, None).columns).write.mode("overwrite").parquet(f"{now}/messages")
    messages = _table(spark, _MESSAGES, f"{now}/messages")
    # A message is finished with the row that has its last piece; only long ones have others.
    whole, others = messages.where("complete"), messages.where("not complete")
    ended = whole.where("part > 0").select(*_KEY)
    broken = waiting.join(named, "path", "left_anti").withColumn("complete", F.lit(False))
    finished = whole.unionByName(others.join(ended, _KEY, "left_semi")).unionByName(broken)
    rich = logs.merge_json(logs.with_pod(finished, pods))
    log_source.write_streams(rich, target, prefix, run=last + 1)
    others.join(ended, _KEY, "left_anti").drop("complete").write.mode("overwrite").parquet(f"{now}/open")
    paths.make_dir(spark, f"{now}/done")
    if last > 0:
        paths.drop_dir(spark, f"{state}/run={last - 1}")
    return last + 1
