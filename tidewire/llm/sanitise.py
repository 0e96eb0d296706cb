"""Personal data: known patterns, and terms that reveal the entities found.

A term discloses an entity as far as it tells which one is meant: the pointwise
mutual information of term and entity over the corpus, as a share of the
information of the entity itself (1: the term occurs with this entity only), smoothed
for rare pairs. Terms whose share exceeds a threshold are generalised wherever they
stand, those above a second one removed. Counts are whole documents, over the whole
corpus. Expressions and joins of Spark only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.spans import ends_before, in_chunks, let, matches, no_spans, piece, placed, replaced
from tidewire.llm.store import written

# The kinds and patterns of the base scan. Where a run of characters fails at
# its first place it fails at the others, so each run is tried once; groups repeat without
# going back, as nothing follows them.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}][\p{L}\p{N}'_-]{2,}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
    ))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _octet_ok(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.lpad(short, 3, "0") <= "255")


def base_spans(text: Column) -> Column:
    """The base scan, sorted; matches that fail their check are dropped, without another try."""
    email = matches(text, EMAIL, "email", 0, F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, IP, "ip", 1), lambda s: F.forall(F.split(s["value"], r"\."), _octet_ok))
    # A run with fewer than 12 digits fails, so only texts with more are searched for places.
    has_card = text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
    card = F.filter(
        matches(text, CARD, "card", 2, has_card),
        lambda s: F.length(_digits(s["value"])).between(12, 19) & luhn(_digits(s["value"])),
    )
    phone = F.filter(
        matches(text, PHONE, "phone", 3, F.contains(text, F.lit("+"))),
        lambda s: F.length(_digits(s["value"])).between(9, 15),
    )
    return F.sort_array(F.concat(email, ip, card, phone))


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _veiled(text: Column, base: Column) -> Column:
    """``text`` with the letters and digits of its base spans replaced by a letter that no base span has.

    TERM finds its matches at the same places in both; those that differ overlap a base span.
    """

    def put(held: Column, before: Column, chunks: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            low = F.greatest(F.get(before, i), s["start"])
            gap = piece(chunks, F.get(before, i), low - F.get(before, i))
            veil = F.regexp_replace(piece(chunks, low, F.greatest(s["end"] - low, F.lit(0))), "[A-Za-z0-9]", "\u2e2f")
            return F.concat(gap, veil)

        last = F.greatest(F.element_at(before, -1), F.element_at(held, -1)["end"])
        return F.concat(F.array_join(F.transform(held, one), ""), piece(chunks, last, F.length(text) - last))

    done = let(base, lambda held: let(ends_before(held), lambda before: let(in_chunks(text), lambda c: put(held, before, c))))
    return F.when(F.size(base) > 0, done).otherwise(text)


def _found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _terms(text: Column, base: Column) -> Column:
    """The distinct terms of a whole text, in lower case, clear of its base spans."""
    both = F.arrays_zip(_found(text).alias("said"), _found(_veiled(text, base)).alias("seen"))
    clear = F.transform(F.filter(both, lambda w: w["said"] == w["seen"]), lambda w: F.lower(w["said"]))
    return F.array_distinct(F.when(F.size(base) > 0, clear).otherwise(F.transform(_found(text), F.lower)))


def _places(text: Column, base: Column, told: Column) -> Column:
    """Spans of every place where a term of the map ``told`` stands clear of the base spans."""

    def spans(seen: Column) -> Column:
        def share(said: Column, i: Column) -> Column:
            return F.when(said == F.get(seen, i), F.try_element_at(told, F.lower(said))).cast("string")

        return F.filter(placed(text, TERM, _found(text), "term", 4, share), lambda s: s["value"].isNotNull())

    return let(_found(_veiled(text, base)), spans)


def _share(both: Column, term: Column, entity: Column, documents: int, prior: float) -> Column:
    """The share of an entity's information that a term gives away, smoothed by ``prior`` documents without it.

    Above 0 it grows with ``both``, so with both = least(term, entity) it bounds what the pair can reach.
    """
    information = F.log(F.lit(float(documents)) / entity)
    shared = F.log(both * F.lit(float(documents)) / (term * entity))
    return F.when(information > 0, shared / information * both / (both + F.lit(prior))).otherwise(F.lit(0.0))


def _telling(found: DataFrame, disclosure: float, prior: float, broadcast_rows: int) -> DataFrame:
    """(term, share): the terms whose share for some entity reaches ``disclosure``, with the largest share.

    Counts are of whole documents. Pairs are counted only where the counts of term and
    entity allow the threshold to be reached at all; the bound is exact, so none is lost.
    """
    documents = max(found.count(), 1)

    def share(both: Column) -> Column:
        return _share(both, F.col("with_term"), F.col("with_entity"), documents, prior)

    def reachable_by(term: Column, entity: Column) -> Column:
        bound = _share(F.least(term, entity), term, entity, documents, prior) >= disclosure
        return bound if disclosure > 0 else F.lit(True)

    in_doc = found.where(F.size("base") > 0)
    held = in_doc.select("row", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    entities = written(
        held.groupBy("entity")
        .agg(F.count(F.lit(1)).alias("with_entity"))
        .where(reachable_by(F.col("with_entity"), F.col("with_entity"))),
        "personal-entities",
    )
    most = F.lit(entities.agg(F.max("with_entity")).first()[0] or 1)
    counted = written(
        found.select(F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("with_term"))
        .where(reachable_by(F.col("with_term"), most)),
        "personal-terms",
    )
    few = counted.limit(broadcast_rows + 1).count() <= broadcast_rows
    near = in_doc.select("row", F.explode("terms").alias("term")).join(F.broadcast(counted) if few else counted, "term")
    return written(
        near.join(held.join(entities, "entity"), "row")
        .where(reachable_by(F.col("with_term"), F.col("with_entity")))
        .groupBy("entity", "term", "with_term", "with_entity")
        .agg(F.count(F.lit(1)).alias("with_both"))
        .select("term", share(F.col("with_both")).alias("share"))
        .where(F.col("share") >= disclosure)
        .groupBy("term")
        .agg(F.max("share").alias("share")),
        "personal-telling",
    )


def find_personal(
    docs: DataFrame,
    disclosure: float = 0.9,
    prior: float = 0.2,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """doc_id, text_hash, base and spans (sorted arrays) for every row of ``docs``.

    ``base`` are the known patterns; ``spans`` these and every place of a disclosing
    term in any text, with the entity or without it, clear of the base spans. Their value
    is the largest share of an entity's information that the term gives away. The share is
    smoothed, not cut off: with ``prior`` = 0.2 a pair that is never apart has 0.83 in one
    document, where every rare word is, and 0.91 in two.

    Null text: empty. Null doc_id: scanned like any other. Repeated rows: each
    counts as a document, each gets the same spans. Rows of one doc_id with
    different texts are told apart by the texts' hash. Empty table: empty result.
    Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"))
    scanned = keyed.withColumn("base", base_spans(F.col("text"))).withColumn("row", F.monotonically_increasing_id())
    found = written(scanned.withColumn("terms", _terms(F.col("text"), F.col("base"))), "personal")
    telling = _telling(found, disclosure, prior, broadcast_rows)
    few = telling.limit(broadcast_rows + 1).count() <= broadcast_rows
    told = written(
        found.select("row", F.explode("terms").alias("term"))
        .join(F.broadcast(telling) if few else telling, "term")
        .groupBy("row")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told")),
        "personal-told",
    )
    # Bounded by all their terms, not only by the texts that have some.
    small = (told.agg(F.sum(F.size("told"))).first()[0] or 0) <= broadcast_rows
    joined = found.drop("terms").join(F.broadcast(told) if small else told, "row", "left")
    places = F.when(F.col("told").isNull(), no_spans()).otherwise(_places(F.col("text"), F.col("base"), F.col("told")))
    return joined.select("doc_id", "text_hash", "base", F.sort_array(F.concat("base", places)).alias("spans"))


def sanitise(docs: DataFrame, remove_at: float = 0.98, **settings) -> DataFrame:
    """``docs`` with personal data replaced by its kind and disclosing terms generalised or removed.

    A term whose share is at least ``remove_at`` is removed; any other reported
    term is generalised to ``[NAME]`` or ``[NUMBER]``. The columns stay as they are.
    """
    found = (
        find_personal(docs, **settings)
        .where(F.size("spans") > 0)
        .select(F.col("doc_id").alias("s_doc_id"), F.col("text_hash").alias("s_hash"), F.col("spans").alias("s_spans"))
        .dropDuplicates(["s_doc_id", "s_hash"])
    )
    text = docs["text"]

    def by(s: Column) -> Column:
        term = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        plain = F.when(term.rlike("^[0-9]+$"), "[NUMBER]").otherwise("[NAME]")
        return F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(
            F.when(s["value"].try_cast("double") >= remove_at, "").otherwise(plain)
        )

    on = docs["doc_id"].eqNullSafe(found["s_doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(found["s_hash"])
    joined = docs.join(found, on, "left")
    clean = F.when(found["s_spans"].isNotNull(), replaced(text, found["s_spans"], by)).otherwise(text)
    return joined.select(*[clean.alias(c) if c == "text" else docs[c].alias(c) for c in docs.columns])
