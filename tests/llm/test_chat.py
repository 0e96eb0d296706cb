import itertools
import random

from llm_helpers import rows_of

from tidewire.llm.chat import escaped, format_chats, read_chats, unescaped
from pyspark.sql import functions as F

PIECES = ["<", "s>", "/s>", "</s>", "<s>", "[", "INST]", "/INST]", "[SEP]", "\\", "~", "\n", "x", " ", "]", "é𝒳"]


def told(turns):
    """Expected turns and loss text per conversation."""
    out = {}
    for conv, turn, role, text in sorted(turns, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def check(work, rows, extra=""):
    turns = work.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = format_chats(turns)
    assert formatted.count() == len({r[0] for r in rows})
    expected = told(rows)
    for row in read_chats(formatted).collect():
        want = expected[row["conv_id"]]
        assert [(t["role"], t["text"]) for t in row["turns"]] == want
        assert row["loss_text"] == "".join(t for r, t in want if r == "assistant")
        blocks = sum(1 for _ in itertools.groupby(r for r, _ in want))
        assert row["formatted"].count("<s>") == blocks == row["formatted"].count("</s>")
        assert row["formatted"].count("[SEP]") == len(want) - blocks
        assert "[INST]" not in row["formatted"]


def test_escape_is_reversible_and_hides_all_control_strings(work):
    texts = ["".join(p) for n in (1, 2, 3) for p in itertools.product(PIECES[:12], repeat=n)]
    df = work.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u")).collect()
    for r in got:
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]", "[SEP]"))


def test_round_trip_of_random_chats(work):
    pick = random.Random(9)
    rows = [
        (conv, turn, pick.choice(["user", "assistant", "assistant", "system", "a\nb~1", "<s>"]), "".join(pick.choices(PIECES, k=pick.randint(0, 9))))
        for conv in range(60)
        for turn in range(pick.randint(1, 9))
    ]
    check(work, rows)


def test_nulls_ties_repeats_and_long_texts(work):
    rows = [
        (None, 0, "user", "no conversation id"),
        (1, None, "user", "no turn"),
        (1, 0, None, "no role"),
        (1, 1, "assistant", None),
        (1, 1, "assistant", "same turn"),
        (1, 1, "assistant", "same turn"),
        (2, 0, "assistant", "long " * 40_000),
        (2, 1, "assistant", ""),
    ]
    check(work, rows)


def test_ignores_other_columns_and_an_empty_table(work):
    turns = work.createDataFrame(
        [(1, 0, "user", "a", "x", "y", 3)],
        "conv_id long, turn long, role string, text string, formatted string, rows string, blocks int",
    )
    assert rows_of(format_chats(turns), "conv_id", "formatted") == [(1, "<s>user\na</s>")]
    assert format_chats(turns.where("1 = 0")).count() == 0


def test_plan_has_no_python(work):
    turns = work.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string").selectExpr("*")
    plan = read_chats(format_chats(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_long_chat_takes_little_time(work):
    """16,000 turns: linear in their number, and read back as they were."""
    import time

    from pyspark.sql import functions as F

    n = 16_000
    turns = work.range(n).select(
        F.lit(1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("é [SEP] "), F.col("id").cast("string")).alias("text"),
    )
    begin = time.perf_counter()
    (row,) = read_chats(format_chats(turns)).collect()
    assert time.perf_counter() - begin < 60
    assert [(t["role"], t["text"]) for t in row["turns"]] == [("user" if k % 3 == 0 else "assistant", f"é [SEP] {k}") for k in range(n)]
    assert row["loss_text"] == "".join(f"é [SEP] {k}" for k in range(n) if k % 3)
