import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import real_docs, rows_of, words_of

from tidewire.llm.recompress import LONGEST, remove_repeats, symbols
from tidewire.llm.words import scan


def brute(rows):
    first, texts = {}, [(d, words_of(t)) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - 49) if d is not None else ():
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - 49) if d is not None else ():
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def digests(docs):
    return rows_of(remove_repeats(docs, "digest"))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(work, seed):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[pick.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 60, 75, 120, 200)]
    passages += [["a"] * 130, ["a", "b"] * 60, ["a", "a", "b"] * 50, ["x", "y", "z", "z"] * 40]
    rows = []
    for i in range(160):
        words = []
        for _ in range(pick.randint(0, 5)):
            kind = pick.random()
            if kind < 0.4:
                p = pick.choice(passages)
                words += p[pick.randint(0, 10) : len(p) - pick.randint(0, 10)]
            elif kind < 0.5:
                words += [pick.choice("ab")] * pick.randint(1, 140)
            else:
                words += [pick.choice(vocabulary) for _ in range(pick.randint(1, 60))]
        rows.append((pick.randint(-1000, 10**6) if i % 40 else None, " \n".join(words) if i % 31 else None))
    rows += rows[:20] + [(d + 7 if d else 1, t) for d, t in rows[20:50]]
    docs = work.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = digests(docs)
    assert got == brute(rows) and sum(r[2] for r in got) > 1000


def test_equals_brute_force_on_real_texts(work):
    docs = real_docs(work)
    assert digests(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_texts_and_empty_table(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert digests(odd_docs) == brute(rows)
    assert digests(no_docs) == []


def test_text_output(work):
    docs = work.createDataFrame([(1, "a  b\nc")], "doc_id long, text string")
    assert remove_repeats(docs).first().asDict() == {"doc_id": 1, "n_words": 3, "n_removed": 0, "text": "a b c"}


def test_symbols_are_bounded_and_cover_all_words():
    pick = random.Random(3)
    texts = [" ".join(pick.choice("abc") for _ in range(pick.randint(0, 90))) for _ in range(50)]
    s = scan(pa.array(texts))
    _, start, size = symbols(s.hashes, s.first)
    assert size.max() <= LONGEST and size.sum() == len(s.hashes)
    assert (start == np.cumsum(size) - size).all()
    assert set(s.first[:-1][s.counts > 0]) <= set(start)
