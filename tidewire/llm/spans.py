"""Places of pattern matches in whole texts, with Spark functions only.

A span is a struct (start, kind_no, end, kind, value); places are code points,
the end is exclusive. Sorted spans come by start, then in the order of kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,kind_no:int,end:int,kind:string,value:string>"
SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


#: Items of an array that are summed up together, and code points of a text that are held together.
STRIDE_BITS, CHUNK = 7, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, first: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each item of an array, ``first`` joined with all items before it.

    Strides of items are joined first; an item then takes those before its stride and the ones of
    its own. No array is grown item by item, which would copy it each time.
    """
    stride = 1 << STRIDE_BITS

    def below(v: Column, sums: Column) -> Column:
        bases = F.transform(sums, lambda _, k: F.aggregate(F.slice(sums, F.lit(1), k), first, join))
        return let(
            bases,
            lambda base: F.transform(
                v,
                lambda _, i: F.aggregate(
                    F.slice(v, F.shiftleft(F.shiftright(i, STRIDE_BITS), STRIDE_BITS) + 1, i.bitwiseAND(stride - 1)),
                    F.get(base, F.shiftright(i, STRIDE_BITS)),
                    join,
                ),
            ),
        )

    def strides(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.shiftright(F.size(v), STRIDE_BITS))
        return F.transform(numbers, lambda k: F.aggregate(F.slice(v, F.shiftleft(k, STRIDE_BITS) + 1, F.lit(stride)), first, join))

    return let(values, lambda v: let(strides(v), lambda sums: below(v, sums)))


def starts_of(sizes: Column) -> Column:
    """Where each item begins, from the sizes of all."""
    return running(sizes, F.lit(0), lambda a, x: a + x)


def count_below(sorted_values: Column, limit: Column) -> Column:
    """How many of ascending integers are less than ``limit``, by halving."""
    whole = F.struct(F.lit(0).alias("low"), F.size(sorted_values).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        less = (s["low"] < s["high"]) & (F.get(sorted_values, middle) < limit)
        return F.struct(
            F.when(less, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(less | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"),
        )

    # Halved once more often than the number has binary digits, none is left.
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_values) + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, whole, halve, lambda s: s["low"])


def in_chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(chunks: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` of a text in chunks; those before are not walked over."""
    first = F.floor(start / CHUNK).cast("int")
    number = F.floor((start + size) / CHUNK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(chunks, first + 1, number), ""), start - first * CHUNK + 1, size)


def placed(text: Column, pattern: str, found: Column, kind: str, kind_no: int, value: Callable | None = None) -> Column:
    """A span for each of the matches ``found`` of a pattern, by the texts between them.

    ``value`` gives a span's value from the match and its place among the matches; by default the match itself.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"))

    def spans(p: Column, at: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            start = F.get(at, i) + F.length(w["gap"])
            told = w["found"] if value is None else value(w["found"], i)
            return span(start, kind_no, start + F.length(w["found"]), kind, told)

        return F.filter(F.transform(p, one), lambda s: s["end"].isNotNull())

    sizes = lambda p: F.transform(p, lambda w: F.length(w["gap"]) + F.coalesce(F.length(w["found"]), F.lit(0)))
    return let(pairs, lambda p: let(starts_of(sizes(p)), lambda at: spans(p, at)))


def matches(text: Column, pattern: str, kind: str, kind_no: int, where: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a pattern that matches no empty string.

    The texts between the matches and the matches themselves give the places. Texts
    without a match, and those outside ``where``, are passed over by one search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    applies = text.rlike(pattern) if where is None else where & text.rlike(pattern)
    return F.when(applies, placed(text, pattern, found, kind, kind_no)).otherwise(no_spans())


def span(start: Column, kind_no: int, end: Column, kind: str, value: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        F.lit(kind_no).alias("kind_no"),
        end.cast("int").alias("end"),
        F.lit(kind).alias("kind"),
        value.alias("value"),
    ).cast(SPAN)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def ends_before(spans: Column) -> Column:
    """For each of sorted spans, the greatest end of those before it; 0 for the first."""
    return running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the sorted ``others``."""

    def clear(held: Column, starts: Column, ends: Column) -> Column:
        def apart(s: Column) -> Column:
            # Of the others that begin before its end, the one that ends last.
            n = count_below(starts, s["end"])
            last = F.get(held, n - 1)["end"]
            return (n == 0) | (F.greatest(F.get(ends, n - 1), last) <= s["start"])

        return F.filter(spans, apart)

    starts = lambda held: F.transform(held, lambda s: s["start"])
    found = let(others, lambda held: let(starts(held), lambda at: let(ends_before(held), lambda to: clear(held, at, to))))
    return F.when((F.size(others) == 0) | (F.size(spans) == 0), spans).otherwise(found)


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """``text`` with each sorted span replaced by ``by(span)``; overlapping spans become one."""

    def put(held: Column, before: Column, chunks: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            gap = piece(chunks, F.get(before, i), s["start"] - F.get(before, i))
            return F.when(s["start"] >= F.get(before, i), F.concat(gap, by(s))).otherwise("")

        last = F.greatest(F.element_at(before, -1), F.element_at(held, -1)["end"])
        rest = piece(chunks, last, F.greatest(F.length(text) - last, F.lit(0)))
        return F.concat(F.array_join(F.transform(held, one), ""), rest)

    done = let(spans, lambda held: let(ends_before(held), lambda before: let(in_chunks(text), lambda c: put(held, before, c))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
