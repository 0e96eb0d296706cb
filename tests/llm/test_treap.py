import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import real_docs

from tidewire.llm import treap

TERM = re.compile(treap.TERM)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, k=10):
    """Every document scored for every item; rows of one item_id are one item."""
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(TERM.findall(lower(text)))
    out = {}
    for item, terms in asked.items():
        scored = []
        for (doc, c), n in zip(counts, sizes, strict=True):
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total)))
                for t in terms
                if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        best = heapq.nsmallest(k, scored, key=lambda x: (x[0], x[1], x[2] or 0))
        if best:
            out[item] = [(doc, -s) for s, _, doc in best]
    return out


def answer(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


@pytest.mark.parametrize("points, docs, terms", [(2_000_000, 65_536, 200_000), (300, 40, 60), (1, 1, 1)])
def test_equals_brute_force(work, points, docs, terms):
    pick = random.Random(points)
    words = ["alpha", "Beta", "γάμμα", "d4", "é", "zeta", "eta", "the", "of"]
    texts = [(i, " ".join(pick.choices(words, [1, 2, 1, 1, 1, 3, 1, 30, 30], k=pick.choice([0, 1, 3, 9, 40])))) for i in range(900)]
    texts += [(1000 + i, "the same text, alpha") for i in range(60)]  # ties
    items = [(i, "-".join(pick.sample(words, pick.randint(1, 7)))) for i in range(25)] + [(3, "d4"), (None, "BETA"), (99, "unknown"), (98, None), (97, " ")]
    d = work.createDataFrame(texts, "doc_id long, text string").repartition(3)
    i = work.createDataFrame(items, "item_id long, text string")
    if docs == 1:
        d, i, texts, items = d.where("doc_id < 40"), i.where("item_id < 4"), texts[:40], [x for x in items if x[0] in range(4)]
    got = answer(treap.rank_documents(d, i, block_terms=terms, shard_points=points, shard_docs=docs))
    assert got == brute(texts, items)


def test_whole_tables(work):
    docs = real_docs(work)
    items = work.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert answer(treap.rank_documents(docs, items)) == brute(pairs(docs, "doc_id"), pairs(items, "item_id"))


def test_odd_documents(odd_docs, no_docs):
    items = odd_docs.selectExpr("doc_id % 3 AS item_id", "text", "1 AS rank", "doc_id", "2 AS score", "lang AS item")
    got = answer(treap.rank_documents(odd_docs, items))
    expected = brute(pairs(odd_docs, "doc_id"), pairs(items, "item_id"))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in expected.items()}
    assert answer(treap.rank_documents(no_docs, items)) == {}
    assert answer(treap.rank_documents(odd_docs, items.where("1 = 0"))) == {}
    assert treap.rank_documents(no_docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_and_hash_hits_are_compared_byte_by_byte():
    import pyarrow as pa

    texts = ["Ab-cD é4", None, "", "x", "x", "_ÀÉ_", "end", "ab"]
    t = treap.terms_of(pa.array(texts))
    found = [bytes(t.data[a:b]).decode() for a, b in zip(t.begin, t.end, strict=True)]
    assert found == [w for s in texts for w in TERM.findall(lower(s))]
    vocabulary = treap.Vocabulary(["ab", "end", "zz"])
    vocabulary.hashes[:] = np.sort(vocabulary._hashes(t)[[0, 1, 2]])  # wrong hits
    places, rows = vocabulary.rows_of(t)
    assert all(found[p] == ["ab", "end", "zz"][r] for p, r in zip(places, rows, strict=True))


def test_treap_has_every_point_and_leaves_ranges_out():
    pick = np.random.default_rng(2)
    side, rows = 4096, np.arange(12) * 300
    row, column = np.repeat(rows, 2000), np.concatenate([pick.choice(side, 2000, False) for _ in rows])
    value = pick.integers(1, 1000, len(row))
    value[:5] = 50_000
    tree = treap.Treap(row, column, value, side)
    exact = np.zeros((len(rows), side), np.int64)
    exact[np.repeat(np.arange(len(rows)), 2000), column] = value
    split = []
    part = tree.part
    tree.part = lambda level, cell, which: split.append(len(cell)) or part(level, cell, which)
    weights = np.arange(1, 13)
    columns, scores = treap.best_of(tree, rows, weights, 5, 1, step=16)
    totals = weights @ exact
    least = np.sort(totals)[-5]
    assert sorted(columns.tolist()) == np.flatnonzero(totals >= least).tolist()
    assert scores.tolist() == totals[columns].tolist()
    assert sum(split) / 2 < 0.5 * side


def test_impacts_beyond_64_bits():
    n, docs, total = 10**9, 10**12, 10**20
    m = 10 + 90 * n * docs // total
    assert treap.impacts(np.array([7]), np.array([n]), docs, total).tolist() == [10**9 * 7 // (7000 + 8 * m)]
