"""Range functions over metric samples on a grid of evaluation times.

How the work is spread: the grid is cut into chunks of consecutive evaluation
times, and a sample goes to every chunk whose windows can see it (one, or two
near an edge). Each (series, chunk) is ordered once. Within it a sample answers
directly for the times at which it is the newest sample of the window, and for
those at which it is the oldest; the two meet in a group-by on the same
partitioning. So there is one shuffle, rows are not multiplied by the number of
windows that overlap them, and a series that holds most of the samples is
spread over its chunks. A store keeps at most one sample per series and
millisecond, which bounds a chunk.

A series is known by a 128-bit hash of its metric and labels. The labels
themselves are far larger than a sample, so only those a caller keeps are
shuffled: none for a plain sum, the ``by`` labels for a grouped one.

Windows are open on the left: ``(t - window, t]``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.labels import SERIES, entries, series_id
from tidewire.plans.tables import utc_day

# Fixed value: how far back an instant selector looks.
LOOKBACK = timedelta(minutes=5)

_MICROS = 1_000_000

Keep = Mapping[str, Column] | None


def named(samples: DataFrame) -> list[Column]:
    """What names the series of a sample: as it came with it, or worked out."""
    return [F.col(c) for c in SERIES] if set(SERIES) <= set(samples.columns) else series_id()


def _kept(keep: Keep) -> dict[str, Column]:
    """What travels with a sample: by default the metric and all labels, in key order."""
    return {"metric": F.col("metric"), "pairs": entries("labels")} if keep is None else dict(keep)


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _epoch_micros(moment: datetime) -> int:
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return _micros(moment - datetime(1970, 1, 1, tzinfo=timezone.utc))


@dataclass(frozen=True)
class Grid:
    """Evaluation times ``start, start + step, ...`` up to ``end``; naive times are UTC."""

    start: datetime
    end: datetime
    step: timedelta

    def __post_init__(self) -> None:
        if self.step <= timedelta(0) or self.end < self.start:
            raise ValueError("a grid needs a positive step and an end not before its start")

    @property
    def points(self) -> int:
        return (self.end - self.start) // self.step + 1

    @classmethod
    def last_hour(cls, end: datetime, step: timedelta = timedelta(seconds=15)) -> Grid:
        return cls(end - timedelta(hours=1), end, step)

    @classmethod
    def at(cls, moment: datetime) -> Grid:
        return cls(moment, moment, timedelta(seconds=1))


def in_reach(samples: DataFrame, grid: Grid, window: timedelta) -> DataFrame:
    """Samples that some window of the grid can see; a ``day`` column lets the scan skip folders."""
    first = F.timestamp_micros(F.lit(_epoch_micros(grid.start) - _micros(window)))
    last = F.timestamp_micros(F.lit(_epoch_micros(grid.start) + (grid.points - 1) * _micros(grid.step)))
    rows = samples.where((F.col("ts") > first) & (F.col("ts") <= last))
    if "day" in samples.columns:
        rows = rows.where(F.col("day").between(utc_day(first), utc_day(last)))
    return rows


def _chunked(samples: DataFrame, grid: Grid, window: timedelta, chunk: timedelta | None, keep: Keep) -> DataFrame:
    """Samples that some window sees, once per chunk, with the neighbours they have there.

    Adds ``at`` (microseconds from the grid start), the index range ``lo..hi``
    of the chunk's windows that see the sample, and the previous and next
    sample.
    """
    start, step, width, points = _epoch_micros(grid.start), _micros(grid.step), _micros(window), grid.points
    span = _micros(chunk or max(4 * window, timedelta(hours=1)))
    per_chunk = max(1, span // step)
    at = F.unix_micros("ts") - F.lit(start)
    seen = (
        in_reach(samples, grid, window)
        .where(F.col("value").isNotNull())
        .select(*named(samples), *[c.alias(n) for n, c in _kept(keep).items()], at.alias("at"), "value")
        .withColumn("lo", _first_index(F.col("at"), step))
        .withColumn("hi", F.least(_last_index(F.col("at") + width, step), F.lit(points - 1)))
        .where("lo <= hi")
        .withColumn("chunk", F.explode(F.sequence(F.expr(f"lo div {per_chunk}"), F.expr(f"hi div {per_chunk}"))))
        .withColumn("lo", F.greatest("lo", F.col("chunk") * per_chunk))
        .withColumn("hi", F.least("hi", F.col("chunk") * per_chunk + (per_chunk - 1)))
    )
    order = Window.partitionBy(*SERIES, "chunk").orderBy("at", "value")
    # A sample that was delivered again is no sample of its own; of one instant the first in order stays.
    once = seen.withColumn("last_at", F.lag("at").over(order)).where(~F.col("at").eqNullSafe(F.col("last_at")))
    return (
        once.drop("last_at")
        .withColumn("before", F.lag(F.struct("at", "value")).over(order))
        .withColumn("next_at", F.lead("at").over(order))
        .withColumn("place", F.row_number().over(order))
        .withColumn("fall", F.when(F.col("value") < F.col("before.value"), F.col("before.value")).otherwise(0.0))
        .withColumn("falls", F.sum("fall").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )


def _first_index(at: Column, step: int) -> Column:
    """Index of the first evaluation time not before ``at``."""
    return F.when(at <= 0, F.lit(0).cast("bigint")).otherwise(_div(at + (step - 1), step))


def _last_index(at: Column, step: int) -> Column:
    """Index of the last evaluation time before ``at``; -1 when there is none."""
    return F.when(at <= 0, F.lit(-1).cast("bigint")).otherwise(_div(at - 1, step))


def _div(value: Column, by: int) -> Column:
    """Whole-number division of values that are not negative."""
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def _newest_until(step: int) -> Column:
    """Last index at which a sample is still the newest of its window."""
    upper = F.when(F.col("next_at").isNull(), F.col("hi")).otherwise(_last_index(F.col("next_at"), step))
    return F.least(F.col("hi"), upper)


def _indexes(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.sequence(lo, hi))


def _result(df: DataFrame, grid: Grid, value: Column, keep: Keep) -> DataFrame:
    start, step = _epoch_micros(grid.start), _micros(grid.step)
    if keep is None:
        names = [F.col("metric"), F.map_from_entries("pairs").alias("labels")]
    else:
        names = [F.col(c) for c in (*SERIES, *keep)]
    return df.select(
        *names, F.timestamp_micros(F.lit(start) + F.col("i") * F.lit(step)).alias("ts"), value.alias("value")
    )


def _newest(samples: DataFrame, grid: Grid, window: timedelta, chunk: timedelta | None, keep: Keep) -> DataFrame:
    """One row per series and evaluation time: the newest sample of the window."""
    rows = _chunked(samples, grid, window, chunk, keep)
    return rows.withColumn("i", F.explode(_indexes(F.col("lo"), _newest_until(_micros(grid.step)))))


def instant(
    samples: DataFrame,
    grid: Grid,
    lookback: timedelta = LOOKBACK,
    chunk: timedelta | None = None,
    keep: Keep = None,
) -> DataFrame:
    """The newest sample of each series within the lookback.

    Like the other range functions it gives ``metric, labels, ts, value``. With
    ``keep`` it gives the columns that name a series, the kept ones, ``ts`` and
    ``value``.
    """
    return _result(_newest(samples, grid, lookback, chunk, keep), grid, F.col("value"), keep)


def irate(
    samples: DataFrame, grid: Grid, window: timedelta, chunk: timedelta | None = None, keep: Keep = None
) -> DataFrame:
    """Per-second rate between the two newest samples of the window."""
    step, width = _micros(grid.step), _micros(window)
    before = F.col("before")
    pairs = _newest(samples, grid, window, chunk, keep).where(before["at"] > F.col("i") * step - width)
    rise = F.when(F.col("value") < before["value"], F.col("value")).otherwise(F.col("value") - before["value"])
    seconds = (F.col("at") - before["at"]) / F.lit(float(_MICROS))
    return _result(pairs.where(F.col("at") > before["at"]), grid, rise / seconds, keep)


def _extrapolated(
    samples: DataFrame, grid: Grid, window: timedelta, counter: bool, chunk: timedelta | None, keep: Keep
) -> tuple[DataFrame, Column]:
    """Change over each window, stretched towards the window's edges."""
    step, width = _micros(grid.step), _micros(window)
    rows = _chunked(samples, grid, window, chunk, keep)
    oldest_from = F.greatest(
        F.col("lo"), F.coalesce(_first_index(F.col("before.at") + width, step), F.lit(0).cast("bigint"))
    )
    ends = F.concat(
        F.transform(
            F.coalesce(_indexes(F.col("lo"), _newest_until(step)), F.array().cast("array<bigint>")),
            lambda i: F.struct(i.alias("i"), F.lit(True).alias("newest")),
        ),
        F.transform(
            F.coalesce(_indexes(oldest_from, F.col("hi")), F.array().cast("array<bigint>")),
            lambda i: F.struct(i.alias("i"), F.lit(False).alias("newest")),
        ),
    )
    # What is kept depends on the series alone; as a key it needs no aggregate.
    keys = [*SERIES, *_kept(keep), "chunk", "i"]
    marked = rows.withColumn("end", F.explode(ends)).withColumns({"i": F.col("end.i"), "newest": F.col("end.newest")})

    def pick(column: str, newest: bool) -> Column:
        return F.max(F.when(F.col("newest") == F.lit(newest), F.col(column)))

    pairs = marked.groupBy(*keys).agg(
        *[pick(c, newest).alias(f"{c}_{end}") for end, newest in (("a", False), ("z", True)) for c in ("at", "value", "place", "falls")]
    )
    pairs = pairs.where(F.col("at_z") > F.col("at_a"))
    change = F.col("value_z") - F.col("value_a")
    if counter:
        change = change + F.col("falls_z") - F.col("falls_a")
    second = float(_MICROS)
    pairs = (
        pairs.withColumn("change", change)
        .withColumn("covered", (F.col("at_z") - F.col("at_a")) / second)
        .withColumn("gap", F.col("covered") / (F.col("place_z") - F.col("place_a")))
        .withColumn("lead_in", (F.col("at_a") - (F.col("i") * step - width)) / second)
        .withColumn("lead_out", (F.col("i") * step - F.col("at_z")) / second)
    )
    far = F.col("gap") * 1.1
    lead_in = F.when(F.col("lead_in") >= far, F.col("gap") / 2).otherwise(F.col("lead_in"))
    if counter:
        # A counter starts at zero: do not stretch past the point where it would be.
        to_zero = F.col("covered") * F.col("value_a") / F.col("change")
        lead_in = F.when((F.col("change") > 0) & (F.col("value_a") >= 0), F.least(lead_in, to_zero)).otherwise(lead_in)
    lead_out = F.when(F.col("lead_out") >= far, F.col("gap") / 2).otherwise(F.col("lead_out"))
    return pairs, F.col("change") * (F.col("covered") + lead_in + lead_out) / F.col("covered")


def increase(
    samples: DataFrame, grid: Grid, window: timedelta, chunk: timedelta | None = None, keep: Keep = None
) -> DataFrame:
    """Growth of a counter over each window; a fall counts as a restart from zero."""
    pairs, value = _extrapolated(samples, grid, window, True, chunk, keep)
    return _result(pairs, grid, value, keep)


def rate(
    samples: DataFrame, grid: Grid, window: timedelta, chunk: timedelta | None = None, keep: Keep = None
) -> DataFrame:
    """``increase`` per second."""
    pairs, value = _extrapolated(samples, grid, window, True, chunk, keep)
    return _result(pairs, grid, value / F.lit(window.total_seconds()), keep)


def delta(
    samples: DataFrame, grid: Grid, window: timedelta, chunk: timedelta | None = None, keep: Keep = None
) -> DataFrame:
    """Change of a gauge over each window."""
    pairs, value = _extrapolated(samples, grid, window, False, chunk, keep)
    return _result(pairs, grid, value, keep)


# Range functions by name; the instant selector takes its lookback as window.
FUNCTIONS = {"instant": instant, "irate": irate, "increase": increase, "rate": rate, "delta": delta}
