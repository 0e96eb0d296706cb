"""Secret scans: known patterns, and weak candidates linked to their other parts.

A credential often has several parts: who (an access identifier), with what (a
secret) and where (an endpoint). A weak candidate alone says little, so it is
reported only when complementary parts stand within ``scope`` code points of it.
Expressions and joins of Spark only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.spans import SPANS, clear_of, let, matches, replaced
from tidewire.llm.store import written

# The kinds and patterns of the base scan; letters of the names in either case.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Parts that count only together: a name for who, a long mixed string, a place.
WEAK_ID = (
    r"""(?i:user(?:name)?|login|account(?:_id)?|client_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?"""
    r"[A-Za-z0-9_.@+-]{3,}"
)
WEAK_SECRET = r"[A-Za-z0-9+/_-]{28,}={0,2}"
WEAK_ENDPOINT = (
    r"""(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\x20\x09-\x0D"'<>]+"""
    r"""|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]{2,5})?"""
)


def base_spans(text: Column) -> Column:
    """The base scan, sorted; matches that fail their length are dropped."""
    assign = F.filter(
        matches(text, ASSIGN, "assign", 0),
        lambda s: F.length(F.regexp_replace(s["value"], ASSIGN_HEAD, "")) >= LEAST["assign"],
    )
    access = F.filter(matches(text, ACCESS, "access", 1), lambda s: F.length(s["value"]) >= LEAST["access"])
    # Every run of hex digits is a match of its own, so only long ones need a place.
    hexes = matches(text, f"(?<![0-9a-f]){HEX[:-1]}{{{LEAST['hex']},}}", "hex", 2)
    return F.sort_array(F.concat(assign, access, hexes))


def _weak(text: Column, base: Column) -> Column:
    """Weak parts of texts that hold an identifier at all, clear of the base spans.

    A long string inside an endpoint or an identifier is a piece of these, not a secret.
    """
    named = F.exists(base, lambda s: s["kind"] == "access") | text.rlike(WEAK_ID)
    secrets = F.filter(
        matches(text, WEAK_SECRET, "weak_secret", 4, named),
        lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"),
    )
    others = F.sort_array(F.concat(matches(text, WEAK_ID, "weak_id", 3, named), matches(text, WEAK_ENDPOINT, "weak_endpoint", 5, named)))
    parts = let(others, lambda held: F.sort_array(F.concat(held, clear_of(secrets, held))))
    return F.when(named, clear_of(parts, base)).otherwise(F.array().cast(SPANS))


_PART = {"access": "who", "weak_id": "who", "assign": "what", "hex": "what", "weak_secret": "what", "weak_endpoint": "where"}


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """(doc_id, text_hash, linked): weak spans with complementary parts in scope.

    Two parts are near where at most ``scope`` code points lie between the end of the one and the
    start of the other; parts that overlap are not. An interval join by blocks of ``scope``
    code points: per document, block and part only the first and last start, and the
    first and last end, are kept. So a text full of parts makes no pairs of them.
    """
    key = ["doc_id", "text_hash"]
    part = reduce(lambda c, kv: c.when(F.col("span.kind") == kv[0], kv[1]), _PART.items(), F)
    rows = (
        found.where(F.size("weak") > 0)
        .select(*key, F.explode(F.concat("base", "weak")).alias("span"))
        .distinct()
        .select(*key, "span", part.alias("part"))
    )
    start, end = F.col("span.start"), F.col("span.end")

    def place(side: str, low: Column, high: Column, near: int = 0) -> Column:
        return F.struct(
            F.lit(side).alias("side"), (F.floor(low / scope) + near).alias("block"), low.alias("low"), high.alias("high")
        )

    def at(*places: Column) -> DataFrame:
        return rows.select("*", F.explode(F.array(*places)).alias("p")).select("*", "p.*").drop("p")

    ends = at(place("start", start, start), place("end", end, end)).groupBy(*key, "side", "block").agg(
        *[
            f(F.when(F.col("part") == p, F.col("low"))).alias(f"{n}_{p}")
            for p in ("who", "what", "where")
            for n, f in (("first", F.min), ("last", F.max))
        ]
    )
    # What begins at most ``scope`` behind its end, and what ends at most so far before its start.
    weak = at(
        *[place("start", end, end + scope, near) for near in (0, 1)],
        *[place("end", start - scope, start, near) for near in (0, 1)],
    ).where(F.col("span.kind").startswith("weak_"))
    on_key = (*key, "side", "block")
    seen = ends.withColumnsRenamed({k: f"e_{k}" for k in on_key})
    on = reduce(lambda a, b: a & b, [weak[k].eqNullSafe(seen[f"e_{k}"]) for k in on_key])

    def within(p: str) -> Column:
        # Of a block's places between first and last one lies in [low, high]: a block is no wider than scope.
        return F.coalesce((F.col(f"last_{p}") >= F.col("low")) & (F.col(f"first_{p}") <= F.col("high")), F.lit(False))

    met = weak.join(seen, on).groupBy(*key, "span", "part").agg(*[F.max(within(p)).alias(p) for p in ("who", "what", "where")])
    reported = (
        F.when(F.col("part") == "who", F.col("what"))
        .when(F.col("part") == "what", F.col("who"))
        .otherwise(F.col("who") & F.col("what"))
    )
    return (
        met.where(reported)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list("span")).alias("linked"))
        .withColumnsRenamed({k: f"l_{k}" for k in key})
    )


def find_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id, text_hash, base and spans (sorted arrays) for every row of ``docs``.

    ``base`` are the known patterns, ``spans`` these and the linked weak candidates.
    Null text: empty. Null doc_id: scanned like any other. Repeated rows: each gets
    the same spans. Rows of one doc_id with different texts are told apart by the
    texts' hash. Empty table: empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text")).withColumn(
        "base", base_spans(F.col("text"))
    )
    found = written(
        scanned.withColumn("weak", _weak(F.col("text"), F.col("base"))).drop("text"), "secrets"
    )
    links = _linked(found, scope)
    joined = found.join(
        links,
        found["doc_id"].eqNullSafe(links["l_doc_id"]) & found["text_hash"].eqNullSafe(links["l_text_hash"]),
        "left",
    )
    every = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "linked")))
    return joined.select("doc_id", "text_hash", "base", every.alias("spans"))


def mask_secrets(docs: DataFrame, scope: int = 200, broadcast_spans: int = 200_000) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``[KIND]``; its columns stay as they are.

    Only the places of spans are joined. They are broadcast while all texts together have at most
    ``broadcast_spans`` of them, else texts and spans are shuffled by doc_id and the text's hash.
    """
    found = (
        find_secrets(docs, scope)
        .where(F.size("spans") > 0)
        .select(
            F.col("doc_id").alias("s_doc_id"),
            F.col("text_hash").alias("s_hash"),
            F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("s_spans"),
        )
    )
    found = written(found.dropDuplicates(["s_doc_id", "s_hash"]), "secret-spans")
    few = (found.agg(F.sum(F.size("s_spans"))).first()[0] or 0) <= broadcast_spans
    text = docs["text"]
    masked = replaced(text, found["s_spans"], lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    on = docs["doc_id"].eqNullSafe(found["s_doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(found["s_hash"])
    joined = docs.join(F.broadcast(found) if few else found, on, "left")
    hit = found["s_spans"].isNotNull()
    changes = {"text": F.when(hit, masked).otherwise(text)}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(hit, F.length(masked).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return joined.select(*[changes.get(c, docs[c]).alias(c) for c in docs.columns])
