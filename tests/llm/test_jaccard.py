import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import real_docs, rows_of, words_of
from pyspark.sql import functions as F

from tidewire.llm import jaccard
from tidewire.llm.components import components
from tidewire.llm.jaccard import link_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute(rows):
    def shingles(text):
        w = words_of((text or "").translate(LOWER))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))

    sets, union, seen, lists = [(d, shingles(t)) for d, t in rows], Union(), {}, defaultdict(list)
    for d, s in sets:
        if d is not None and s:
            union.tie(seen.setdefault(s, d), d)
    for i, s in enumerate(seen):
        for x in s:
            lists[x].append(i)
    whole = list(seen)
    for i, s in enumerate(whole):
        for j, n in Counter(j for x in s for j in lists[x] if j > i).items():
            if 100 * n >= 80 * (len(s) + len(whole[j]) - n):
                union.tie(seen[s], seen[whole[j]])
    return sorted(((d, len(s), None if d is None else union.find(d)) for d, s in sets), key=repr)


def noisy_rows(seed, n=400):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [[pick.choice(vocabulary) for _ in range(pick.choice([5, 8, 30, 60, 90]))] for _ in range(12)]
    common = [pick.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(pick.choice(texts)) if pick.random() < 0.8 else [pick.choice(vocabulary) for _ in range(pick.randint(0, 60))]
        for _ in range(pick.choice([0, 1, 1, 2, 3, 4]) if w else 0):
            j, kind = pick.randrange(len(w)), pick.random()
            if kind < 0.4:
                w[j] = pick.choice(vocabulary)
            elif kind < 0.6 and len(w) > 1:
                del w[j]
            elif kind < 0.8:
                w.insert(j, pick.choice(vocabulary))
            else:
                w += [pick.choice(vocabulary) for _ in range(pick.randint(1, 4))]
        w += common if pick.random() < 0.4 else []
        rows.append((pick.randint(-50, 10**5) if i % 50 else None, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)))
    rows += rows[:20] + [(d + 3 if d else None, t) for d, t in rows[20:50]] + [(rows[3][0], rows[100][1])]
    return rows


@pytest.mark.parametrize("common", [24, 3])
def test_equals_brute_force(work, common):
    rows = noisy_rows(common)
    docs = work.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(link_components(docs, common)) == brute(rows)


def test_equals_brute_force_on_real_texts(work):
    docs = real_docs(work)
    assert rows_of(link_components(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_texts_and_empty_table(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert rows_of(link_components(odd_docs)) == brute(rows)
    assert rows_of(link_components(no_docs)) == []


def test_prefix_is_long_enough():
    for size in range(1, 400):
        least = -(-size * 80 // 100)  # the smallest overlap any partner can have
        assert jaccard.prefix_size(size) == size - least + 1


def test_components_of_a_chain_and_a_hub(work):
    chain = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(7, 7)]
    links = work.createDataFrame(chain, "a long, b long")
    found = dict(rows_of(components(links)))
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(50)} == {0}
    assert rows_of(components(links.where("1 = 0"))) == []


def test_variants_of_one_text_that_are_not_similar_make_no_pairs(work, monkeypatch):
    pick = random.Random(8)
    base, rows = [f"b{i}" for i in range(400)], []
    for i in range(80):
        # Two variants share some 70 % of their shingles, and most of their prefixes' lists.
        w = list(base)
        for j in pick.sample(range(400), 9):
            w[j] = f"n{i}x{j}"
        rows.append((i, " ".join(w)))
    kept, write = [], jaccard.written

    def watched(df, purpose):
        out = write(df, purpose)
        if purpose == "pairs":
            kept.append(out)
        return out

    monkeypatch.setattr(jaccard, "written", watched)
    docs = work.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(link_components(docs)) == brute(rows)
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(396)} for d, t in rows}
    far = [1 for r in kept[-1].collect() if 100 * len(sets[r["a"]] & sets[r["b"]]) < 72 * len(sets[r["a"]] | sets[r["b"]])]
    assert kept[-1].count() < 400 and not far


def test_sketches_never_part_similar_sets(work):
    pick = random.Random(9)
    rows, similar = [], []
    for n in (1, 4, 31, 33, 64, 65, 127, 129, 1000, 1030, 5000, 9000):
        for _ in range(12):
            base = [pick.getrandbits(63) for _ in range(n)]
            x = set(base) | {pick.getrandbits(63) for _ in range(int(n * pick.uniform(0, 0.2)))}
            y = set(base[: n - int(n * pick.uniform(0, 0.25))]) | {pick.getrandbits(63) for _ in range(int(n * pick.uniform(0, 0.1)))}
            told = [jaccard.signed(jaccard._sketch(np.array(sorted(s), np.uint64))).tolist() for s in (x, y)]
            similar.append(100 * len(x & y) >= 80 * len(x | y))
            rows.append((len(rows), *told, len(x) + len(y)))
    pairs = work.createDataFrame(rows, "i long, x array<long>, y array<long>, sizes long")
    near = {r["i"] for r in pairs.where(jaccard._near("x", "y", F.col("sizes"))).select("i").collect()}
    assert near >= {i for i, s in enumerate(similar) if s}
    assert len(near) < len(rows)
    unknown = pairs.withColumn("x", F.lit(None).cast("array<long>"))
    assert unknown.where(jaccard._near("x", "y", F.col("sizes"))).count() == len(rows)
