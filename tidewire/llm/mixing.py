"""Mixing of sources to target weights by repetition rates and seeded Bernoulli copies.

The words that a seed takes of a source scatter around its target, widely where few long
documents hold most of its words. So every source tries some seeds, in one pass over sizes,
and keeps the one whose taken words come nearest to its target. Each try gives every
document its extra copy with the probability of the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(doc_id: Column, seed: str, turn: Column) -> Column:
    """A number in [0, 1) that depends on the id, the seed and the turn alone."""
    digest = F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed), turn.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """One row per source: size, weight, target.

    A target is ``min(most * size, level * weight)``, where ``level`` makes the
    targets share all sizes. That is where handing the excess of full sources to
    the others, again and again, ends. Sources are few, one row each, so ordering
    them in one task is bounded by their number, not by the documents.
    """
    order = Window.orderBy(F.col("mix_source").asc_nulls_last())
    turns = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("turn", F.row_number().over(order)).withColumn(
        "weight", F.element_at(turns, ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_cap = Window.orderBy("full_at", "turn")
    everything = Window.partitionBy()
    upto = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leveled = ranked.select(
        "*",
        F.row_number().over(by_cap).alias("place"),
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("cap").over(upto) - F.col("cap")).alias("caps_before"),
        (F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")).alias("weight_left"),
    )
    level = (F.col("total") - F.col("caps_before")) / F.col("weight_left")
    # The first source that stays below its cap when all before it are full sets the level.
    found = F.min(F.when(level <= F.col("full_at"), F.struct("place", level.alias("level")))).over(everything)["level"]
    return leveled.select(
        "mix_source",
        "source_size",
        F.when(found.isNull(), F.col("cap")).otherwise(F.least("cap", found * F.col("weight"))).alias("target"),
    )


def mix_rates(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: float = 3.0,
    seed: str = "mix",
    source_limit: int = 100_000,
    whole_rows: bool = False,
    tries: int = 32,
) -> DataFrame:
    """doc_id, size, source_size, target and copies for every row of ``docs``, and, if asked, ``row`` itself.

    Sources are taken by code point, null last, and weigh ``weights`` in turn.
    A document is repeated ``floor(rate)`` times, and once more where its chance
    is below the fraction; ``rate`` is its source's target over its size. The chance is
    that of the first of ``tries`` seeds by which the source's words come nearest to its
    target. With many documents a single seed deviates by about the root of the sum of the
    squared sizes times rate fractions; the best of 32 by a twentieth of that. Sources
    are broadcast up to ``source_limit`` of them.

    Null or empty text: size 0, repeated like any other. Null source: a source of
    its own. A source of size 0: target 0, no copies. Repeated rows: each counts,
    with the same chance. Null doc_id: takes the chance of the empty id. An empty
    table gives an empty one. Other columns are ignored.
    """
    sized = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))
    sizes = written(sized, "sizes")
    per_source = sizes.groupBy(F.col("source").alias("mix_source")).agg(F.sum("size").alias("source_size"))
    stats = written(source_targets(per_source, weights, most), "source-targets")
    few = stats.limit(source_limit + 1).count() <= source_limit
    rate = F.least(
        F.lit(float(most)),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)),
    )

    def with_source(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(of) if few else of, rows["source"].eqNullSafe(of["mix_source"]))

    def extra(turn: Column) -> Column:
        return F.when(chance(F.col("doc_id"), seed, turn) < rate - F.floor(rate), 1).otherwise(0)

    taken = F.sum(F.floor(rate) * F.col("size"))
    found = with_source(sizes, stats).groupBy("mix_source", "source_size", "target").agg(
        *[(taken + F.sum(extra(F.lit(k)) * F.col("size"))).alias(f"taken_{k}") for k in range(tries)]
    )
    nearest = F.array_min(
        F.array(*[F.struct(F.abs(F.col(f"taken_{k}") - F.col("target")).alias("off"), F.lit(k).alias("turn")) for k in range(tries)])
    )
    chosen = written(found.select("mix_source", "source_size", "target", nearest["turn"].alias("turn")), "source-seeds")
    if whole_rows:
        sizes = docs.select(
            "doc_id", "source", words_in(F.col("text")).alias("size"), F.struct(*[docs[c] for c in docs.columns]).alias("row")
        )
    joined = with_source(sizes, chosen)
    return joined.withColumn("copies", (F.floor(rate) + extra(F.col("turn"))).cast("long")).drop("mix_source", "source", "turn")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus itself: each row of ``docs``, with its columns, as often as the mix takes it."""
    rated = mix_rates(docs, whole_rows=True, **settings).where(F.col("copies") > 0)
    return rated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
