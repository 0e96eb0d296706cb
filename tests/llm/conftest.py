import os
import sys

import pytest

sys.path.append(os.path.dirname(os.path.abspath(__file__)))

from tidewire.llm.store import reachable  # noqa: E402

# Texts that every operator on documents must bear: null, empty, blank, very long, odd characters, repeats.
ODD_TEXTS = [
    None,
    "",
    " \n\t\x0b\x0c\r ",
    "one",
    "ein zwei drei vier",
    "été à Noël     naïve 漢字 𝒳𝒴 \x00 \x1f end",
    "word " * 30_000,
    "x" * 50_000,
    "\\ \" ' $1 [SEP] <s> ~0 ~1",
    "same text twice in the table",
    "same text twice in the table",
]


@pytest.fixture(scope="session")
def work(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tmp_path_factory.mktemp("shared").as_uri())
    return reachable(spark)


@pytest.fixture(scope="session")
def odd_docs(work):
    """Nulls in every column, repeated rows, one id with two texts, columns with names that operators use."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[9], (3, "another text of the same id", "de", "s0"), (None, "no id here", "fr", "s1"), (None, None, None, None)]
    clash = [(*r, "c", 1, 2, 3, "g", "r") for r in rows]
    return work.createDataFrame(
        clash,
        "doc_id long, text string, lang string, source string, copies string, size int, doc int, hash int, "
        "spans string, row string",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
