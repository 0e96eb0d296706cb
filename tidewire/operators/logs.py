"""Shaping of container logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.codec import one_json_value
from tidewire.functions.containers import pod_of
from tidewire.plans.tables import moment
from tidewire.session import work_dir

# Lines of one file that are put in order together, where its splits are not known.
CHUNK_LINES = 1_000_000
# Bytes of file splits that make a chunk.
CHUNK_SHIFT = 20
# Chunks, and groups of chunks, that are summed up together; three levels do for 2^30 chunks.
FAN_SHIFT = 10
LEVELS = 3
# Bytes of a message in one row; longer ones have several rows.
PART_BYTES = 16 << 20

_SOURCE = ["path", "stream"]


def join_partials(
    lines: DataFrame, chunk: Column | None = None, part_bytes: int = PART_BYTES, staged: str | None = None
) -> DataFrame:
    """Join the pieces of each message: consecutive partial lines up to a full one.

    ``lines`` has ``path, stream, line_no, ts, partial, log``. The result has the line
    number and time of each message's first piece. ``part`` numbers the rows of a message
    from 0: a row takes the pieces that begin in the next ``part_bytes`` bytes of it.
    ``complete`` is true in the row with the last piece; a message without one goes on
    behind the lines that are there.

    A file, and a message, may hold any share of all lines, so neither is put in order as a
    whole. Lines are ordered within chunks of the file: its splits where ``block`` is
    known, else runs of line numbers. There the messages of the chunk are put together, and
    all is written to ``staged``, so lines are made, shuffled and ordered once. Only the pieces at
    the edges of a chunk may belong to messages that go beyond it. By these a chunk is summed
    up in one row: whether a message ends in it, and where the message begins that is open
    behind it and how long it is. These rows are summed up by groups, and the groups by groups;
    from there down each chunk learns which message is open before it. Then a piece at an
    edge knows its message and its part of it, and these are put together, each by itself.
    """
    spark = lines.sparkSession
    staged = staged or work_dir(spark, "messages")
    order = ["block", "line_no"] if "block" in lines.columns else ["line_no"]
    if chunk is None:
        in_file = F.shiftright(F.col("block").cast("long"), CHUNK_SHIFT) if "block" in lines.columns else None
        chunk = in_file if in_file is not None else F.floor(F.col("line_no") / CHUNK_LINES)
    placed = lines.select(
        *_SOURCE, chunk.cast("long").alias("chunk"), F.struct(*order).alias("place"), "line_no", "ts", "partial", "log"
    )
    runs = _runs(placed, part_bytes)
    runs.write.mode("overwrite").parquet(staged)
    held = spark.read.schema(runs.schema).parquet(staged)
    inside = held.where("not edge").select(
        *_SOURCE, F.col("start.line_no").alias("line_no"), F.col("start.ts").alias("ts"), "log", "complete", "part"
    )
    edges = held.where("edge")
    carried = _open_before(_summed_up(edges)).where(F.col("start").isNotNull())
    carried = carried.withColumnsRenamed({"start": "open_start", "bytes": "open_bytes"})
    # Only the head of a chunk may go on from the chunk before.
    head = (F.col("message") == 0) & F.col("open_start").isNotNull()
    told = edges.join(carried, [*_SOURCE, "chunk"], "left").withColumn("item", F.explode("items"))
    before = F.col("item.before") + F.when(head, F.col("open_bytes")).otherwise(0)
    pieces = told.select(
        *_SOURCE,
        F.when(head, F.col("open_start")).otherwise(F.col("start")).alias("start"),
        _part(before, part_bytes).alias("part"),
        "chunk",
        "item.place",
        "item.partial",
        "item.log",
    )
    return inside.unionByName(_joined(pieces))


def _part(before: Column, part_bytes: int) -> Column:
    return F.floor(before / part_bytes).cast("long")


def _runs(lines: DataFrame, part_bytes: int) -> DataFrame:
    """One row for each part of a message in a chunk, with ``log``, or with its ``items`` where it lies at an ``edge``.

    At an edge are the head of a chunk and what has no last piece. ``open`` is the last row of a chunk whose
    message goes on behind it, ``until`` how many bytes of the message are there up to the row's end.
    """
    # All windows go over a chunk in one order, so it is put in order once.
    within = Window.partitionBy(*_SOURCE, "chunk").orderBy("place")
    past, upto = (within.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    size = F.coalesce(F.octet_length("log").cast("long"), F.lit(0))
    # Messages of a chunk are numbered by the full lines before them.
    ends = F.sum(F.when(F.col("partial"), 0).otherwise(1)).over(past)
    numbered = lines.withColumns(
        {
            "message": F.coalesce(ends, F.lit(0)),
            "at": F.coalesce(F.sum(size).over(past), F.lit(0)),
            "begins": F.coalesce(~F.lag("partial").over(within), F.lit(True)),
            "final": F.lead("place").over(within).isNull(),
        }
    ).withColumns(
        {
            "start": F.last(F.when(F.col("begins"), F.struct("line_no", "ts")), ignorenulls=True).over(upto),
            "before": F.col("at") - F.max(F.when(F.col("begins"), F.col("at"))).over(upto),
        }
    )
    runs = numbered.groupBy(*_SOURCE, "chunk", "message", _part(F.col("before"), part_bytes).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("place", "log", "before", "partial"))).alias("items"),
        F.first("start").alias("start"),
        F.max(~F.col("partial")).alias("complete"),
        F.max(F.col("final") & F.col("partial")).alias("open"),
        F.max(F.col("before") + size).alias("until"),
    )
    items, edge = F.col("items"), (F.col("message") == 0) | ~F.col("complete")
    text = F.when(F.size(items) == 1, items[0]["log"]).otherwise(_text(items))
    rest = [*_SOURCE, "chunk", "message", "part", "start", "complete", "open", "until"]
    return runs.select(*rest, edge.alias("edge"), F.when(~edge, text).alias("log"), F.when(edge, items).alias("items"))


def _text(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: i["log"]), "")


def _joined(pieces: DataFrame) -> DataFrame:
    """Concatenate the rows of each part of a message in line order."""
    out = pieces.groupBy(*_SOURCE, "start", "part").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "place", "log"))).alias("items"), F.max(~F.col("partial")).alias("complete")
    )
    return out.select(
        *_SOURCE,
        F.col("start.line_no").alias("line_no"),
        F.col("start.ts").alias("ts"),
        _text(F.col("items")).alias("log"),
        "complete",
        "part",
    )


def _summed_up(edges: DataFrame) -> DataFrame:
    """One row per chunk: ``ends``, and ``start`` and ``bytes`` of the message left open, NULL and 0 without one."""
    # The head of a chunk is there always, and ends if any message of it does.
    chunks = edges.groupBy(*_SOURCE, "chunk").agg(
        F.max((F.col("message") == 0) & F.col("complete")).alias("ends"),
        F.max(F.when(F.col("open"), F.struct("start", "until"))).alias("last"),
    )
    return chunks.select(
        *_SOURCE, "chunk", "ends", F.col("last.start").alias("start"), F.coalesce("last.until", F.lit(0)).alias("bytes")
    )


def _open_before(chunks: DataFrame, level: int = 1) -> DataFrame:
    """(path, stream, chunk, start, bytes): the message that is open before each chunk, over all chunks before it."""
    top = level == LEVELS
    group = F.lit(0).cast("long") if top else F.shiftright("chunk", FAN_SHIFT)
    order = Window.partitionBy(*_SOURCE, "group").orderBy("chunk")
    # A chunk in which a message ends makes the ones before it count no more.
    numbered = chunks.withColumn("group", group).withColumn("since", F.sum(F.col("ends").cast("int")).over(order))
    upto = Window.partitionBy(*_SOURCE, "group", "since").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    after = numbered.withColumn(
        "after",
        F.struct(
            (F.col("since") > 0).alias("ends"),
            F.first("start", ignorenulls=True).over(upto).alias("start"),
            F.sum("bytes").over(upto).alias("bytes"),
        ),
    )
    within = after.withColumn("before", F.lag("after").over(order))
    if top:
        return within.select(*_SOURCE, "chunk", F.col("before.start").alias("start"), F.coalesce("before.bytes", F.lit(0)).alias("bytes"))
    groups = after.groupBy(*_SOURCE, "group").agg(F.max_by("after", "chunk").alias("all"))
    above = _open_before(groups.select(*_SOURCE, F.col("group").alias("chunk"), "all.*"), level + 1)
    above = above.select(*_SOURCE, F.col("chunk").alias("group"), F.col("start").alias("g_start"), F.col("bytes").alias("g_bytes"))
    own = F.coalesce(F.col("before.ends"), F.lit(False))
    return within.join(above, [*_SOURCE, "group"]).select(
        *_SOURCE,
        "chunk",
        F.when(own, F.col("before.start")).otherwise(F.coalesce("g_start", "before.start")).alias("start"),
        (F.when(own, 0).otherwise(F.col("g_bytes")) + F.coalesce("before.bytes", F.lit(0))).alias("bytes"),
    )


def merge_json(logs: DataFrame, column: str = "log") -> DataFrame:
    """Turn a JSON object in the log text into ``fields`` and drop the text.

    Text that is not an object stays and has no fields.
    """
    text = F.col(column)
    # Only what looks like an object is parsed.
    object_only = F.ltrim(text).startswith("{") & one_json_value(text)
    parsed = logs.withColumn("fields", F.when(object_only, F.from_json(text, "map<string,string>")))
    return parsed.withColumn(column, F.when(F.col("fields").isNull(), text))


def with_pod(logs: DataFrame, pods: DataFrame) -> DataFrame:
    """Add the namespace, pod and container of each line, and the pod's metadata.

    ``pods`` has ``namespace, pod_name`` and metadata columns; of several rows
    for one pod the greatest is taken, so no line is repeated. The join is left
    to adaptive execution: it sends the pods to all tasks when they measure
    small, and otherwise splits busy pods over several tasks.
    """
    meta = [c for c in pods.columns if c not in ("namespace", "pod_name")]
    one = pods.groupBy("namespace", "pod_name").agg(F.max(F.struct(*meta)).alias("meta"))
    one = one.select("namespace", "pod_name", *[F.col("meta")[c].alias(c) for c in meta])
    return logs.select("*", *pod_of(F.col("path"))).join(one, ["namespace", "pod_name"], "left")


def latest_streams(logs: DataFrame, limit: int = 5) -> DataFrame:
    """The log streams written to last."""
    last = logs.groupBy("path").agg(F.max("ts").alias("last_event"))
    return last.orderBy(F.col("last_event").desc(), "path").limit(limit)


def recent(logs: DataFrame, as_of: datetime | Column | None = None, back: str = "5 minutes", limit: int = 5) -> DataFrame:
    """The first log events since a moment."""
    since = moment(as_of) - F.expr(f"interval {back}")
    return logs.where(F.col("ts") >= since).orderBy("ts", "path", "log").limit(limit)
