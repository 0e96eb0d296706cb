"""Chat formatting with Spark expressions only: a template that can be read back.

A block is ``<s>role\\ntext</s>``; the texts of adjacent turns of one role share a
block, parted by ``[SEP]``. Control strings inside a text get a backslash behind
their first character, and one more if they have some already, so no text can
open or close a block and every text can be restored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.spans import in_chunks, let, piece, starts_of

OPEN, CLOSE, PART = "<s>", "</s>", "[SEP]"
# The strings that may not stand in a text as they are, behind their first character.
_RESERVED = r"(/?s>|/?INST\]|SEP\])"
_TURNS = "array<struct<role:string,text:string>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _RESERVED, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _RESERVED, "$1$2$3")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1"))


def _role_in(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~")))


def _merged(turns: Column) -> Column:
    """Adjacent turns of one role become one block with an array of texts."""

    def opens(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(t) - 1)
        return F.filter(places, lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, F.greatest(i - 1, F.lit(0)))["role"]))

    def blocks(t: Column, first: Column) -> Column:
        def block(at: Column, k: Column) -> Column:
            own = F.slice(t, at + 1, F.coalesce(F.get(first, k + 1), F.size(t)) - at)
            return F.struct(F.get(t, at)["role"].alias("role"), F.transform(own, lambda x: x["text"]).alias("texts"))

        return F.transform(first, block)

    return let(turns, lambda t: let(opens(t), lambda first: blocks(t, first)))


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points, end exclusive).

    Turns are ordered by turn, then role, then text, so ties have one order; a null
    turn comes first. Null text and null role: empty. Repeated rows are turns of
    their own. Rows of null conv_id are one conversation. An empty table gives an
    empty one. Other columns are ignored. A conversation is one row, as its output
    is one string.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("row"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    blocks = sorted_turns.select(
        "conv_id",
        _merged(
            F.transform(
                "rows", lambda r: F.struct(_role_out(r["role"]).alias("role"), escaped(r["text"]).alias("text"))
            )
        ).alias("blocks"),
    )
    shaped = blocks.select(
        "conv_id",
        F.concat_ws(
            "",
            F.transform(
                "blocks",
                lambda b: F.concat(F.lit(OPEN), b["role"], F.lit("\n"), F.array_join(b["texts"], PART), F.lit(CLOSE)),
            ),
        ).alias("formatted"),
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.transform(
                    b["texts"],
                    lambda t, i: F.struct(
                        F.when(i == 0, F.length(b["role"]) + len(OPEN) + 1).otherwise(len(PART)).alias("skip"),
                        F.length(t).alias("size"),
                        F.when(i == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).alias("tail"),
                        b["role"].isin(*trained).alias("trained"),
                    ),
                ),
            )
        ).alias("parts"),
    )
    def spans(parts: Column, at: Column) -> Column:
        each = F.transform(
            parts,
            lambda p, i: F.struct(
                (F.get(at, i) + p["skip"]).alias("start"), (F.get(at, i) + p["skip"] + p["size"]).alias("end"), p["trained"].alias("trained")
            ),
        )
        kept = F.filter(each, lambda s: s["trained"])
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    sizes = lambda parts: F.transform(parts, lambda p: p["skip"] + p["size"] + p["tail"])
    loss = let(F.col("parts"), lambda parts: let(starts_of(sizes(parts)), lambda at: spans(parts, at)))
    return shaped.select("conv_id", "formatted", loss.alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, from the formatted string alone and its spans.

    conv_id, turns (role, text in order), loss_text, formatted.
    """
    blocks = F.filter(F.split(F.col("formatted"), CLOSE, -1), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(_after_role(b), r"\[SEP\]", -1),
                lambda t: F.struct(_role_in(_role_of(b)).alias("role"), unescaped(t).alias("text")),
            ),
        )
    ).cast(_TURNS)
    loss = let(
        in_chunks(F.col("formatted")),
        lambda c: F.array_join(F.transform("loss_spans", lambda s: unescaped(piece(c, s["start"], s["end"] - s["start"]))), ""),
    )
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def _role_of(block: Column) -> Column:
    return F.substring(F.substring_index(block, "\n", 1), F.lit(len(OPEN) + 1), F.length(block))


def _after_role(block: Column) -> Column:
    return F.substring(block, F.length(F.substring_index(block, "\n", 1)) + 2, F.length(block))
