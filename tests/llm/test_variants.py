import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import real_docs, rows_of

from tidewire.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_words(docs):
    counts = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_forms(n):
    near = defaultdict(list)
    lengths = defaultdict(list)
    for w in n:
        lengths[len(w)].append(w)
    for w in n:
        for m in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [x for x in lengths[m] if one_edit(w, x)]
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("cell_words, sample", [(8192, 200_000), (16, 200_000), (16, 60)])
def test_near_words_equal_brute_force(work, cell_words, sample):
    pick = random.Random(cell_words)
    stems = ["".join(pick.choices("abcdeéÿ", k=pick.randint(7, 10))) for _ in range(120)]
    words = set(stems)
    for w in stems:
        for _ in range(4):
            i = pick.randrange(len(w))
            words.add(w[:i] + pick.choice(["", "x", "ab", "é"]) + w[i + pick.randint(0, 1) :])
    n = {w: 10 ** pick.randint(0, 4) * 2 for w in words if len(w) >= 7}
    df = work.createDataFrame(sorted(n.items()), "word string, n long").repartition(3)
    got = {r["word"]: (r["n_near"], r["form_n"], r["form"]) for r in variants.near_words(df, cell_words, sample).collect()}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        assert got.get(w) == ((len(near), n[best], best) if near else None)


def test_query_on_small_texts(work):
    pick = random.Random(3)
    words = ["Tidewire", "tidewires", "tidewirez", "harbours", "harbors", "hàrbours", "colonnade", "colonade", "ÀÉÎÖÜßÿ", "short"]
    weights = [400, 30, 3, 300, 25, 20, 200, 2, 5, 50]
    docs = [(i, " ".join(pick.choices(words, weights, k=40))) for i in range(60)]
    docs += [(None, "unnamed unnamed unnamed"), (7, None), (8, ""), (9, "word " * 20_000 + "z" * 30_000 + " " + "z" * 30_000)]
    df = work.createDataFrame(docs, "doc_id long, text string")
    expected = brute_forms(brute_words(docs))
    assert any(form and root != form for _, form, root, *_ in expected)  # a chain
    assert rows_of(variants.group_variants(df), *COLUMNS) == expected


def test_whole_table(work):
    docs = real_docs(work)
    assert rows_of(variants.group_variants(docs), *COLUMNS) == brute_forms(brute_words(texts_of(docs)))


def test_odd_documents(odd_docs, no_docs):
    named = odd_docs.withColumnsRenamed({"copies": "word", "size": "n", "spans": "form", "row": "root"})
    many = named.unionAll(named).unionAll(named)
    assert rows_of(variants.group_variants(many), *COLUMNS) == brute_forms(brute_words(texts_of(many)))
    assert rows_of(variants.group_variants(no_docs), *COLUMNS) == []


def test_search_reaches_all_one_edit_changes_and_prunes():
    pick = np.random.default_rng(5)
    letters = pick.integers(0, 12, (3000, 10)).astype(np.uint8)
    group = variants.Words(letters, np.ones(3000, np.int64), np.arange(3000))
    vectors = group.vectors()
    tree = variants.build(vectors, np.arange(3000), 16, lambda rows: rows)
    visited = np.zeros(3000, np.int64)
    reached = defaultdict(set)
    for members, rows in variants.search(tree, vectors[:200], True, True):
        visited[rows] += len(members)
        for r in rows.tolist():
            reached[r].update(members.tolist())
    apart = np.abs(vectors[:200, None].astype(int) - vectors[None]).sum(-1)
    for r in range(200):
        assert set(np.flatnonzero(apart[r] <= 2).tolist()) <= reached[r]
    assert visited[:200].mean() < 900


def test_leaf_of_equal_vectors_is_matched_by_halves():
    pick = random.Random(1)
    base = "abcdefgh"
    words = sorted({"".join(pick.sample(base, 8)) for _ in range(700)})
    asks = sorted({w[:i] + "z" + w[i + 1 :] for w in words[:150] for i in (0, 5)} | {w[:3] + w[4:] for w in words[:150]} | {w + "a" for w in words[:50]})
    n = {w: 2 + i % 5 for i, w in enumerate(words)}
    (held,) = variants.by_length(pa.array(words), np.array([n[w] for w in words])).values()
    cell = variants.Cell(held)
    for group in variants.by_length(pa.array(asks), np.ones(len(asks), np.int64)).values():
        found, best, of = cell.answer(group)
        for i, at in enumerate(group.number.tolist()):
            near = [w for w in words if one_edit(asks[at], w)]
            assert found[i] == len(near)
            assert (best[i], words[of[i]]) == max(((n[w], w) for w in near), key=lambda x: x[0])[:1] + (min((w for w in near if n[w] == best[i])),)
