import zlib

import numpy as np
from llm_helpers import real_docs, rows_of
from pyspark.sql import functions as F

from tidewire.llm.langid import fit_prototypes, gram_vectors, grams_of, letter_vectors, predict, remainder


def run(docs):
    rest = remainder(F.col("doc_id"))
    return predict(docs, fit_prototypes(docs, rest != 1), rest == 1)


def plain_grams(text):
    spaced = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    spaced = " " + " ".join(spaced.split()) + " "
    return sorted(spaced[i : i + 3] for i in range(len(spaced) - 2) if spaced[i + 1] != " ")


def test_grams_equal_plain_python():
    texts = ["Hello, World!", None, "", "a", "é1b 漢字", " x  y\n", "İstanbul ΣΑΣ", "...", "don't", "".join(map(chr, range(0x4E00, 0x4F00)))]
    distinct, which, edges = grams_of(texts)
    shown = ["".join(chr(int(g >> s) & 0x1FFFFF or 32) for s in (42, 21, 0)) for g in distinct.tolist()]
    for i, text in enumerate(texts):
        assert sorted(shown[j] for j in which[edges[i] : edges[i + 1]]) == plain_grams(text), text


def test_vectors_are_bound_and_nearly_orthogonal():
    letters = letter_vectors(np.arange(97, 123), 512).astype(int)
    assert set(np.unique(letters)) == {-1, 1}
    assert abs(letters @ letters.T - 512 * np.eye(26)).max() < 140
    a, b, c = letters[:3]
    gram = (np.uint64(97) << np.uint64(42)) | (np.uint64(98) << np.uint64(21)) | np.uint64(99)
    assert (gram_vectors(np.array([gram]), 512)[0] == np.roll(a, 2) * np.roll(b, 1) * c).all()


def test_held_out_accuracy(work):
    docs = real_docs(work, "/root/testdata/sf0.01")
    rows = run(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_rows_teach_nothing_and_reruns_agree(work):
    docs = real_docs(work)
    changed = docs.withColumn("lang", F.when(remainder(F.col("doc_id")) == 1, F.lit("zz")).otherwise(F.col("lang")))
    assert rows_of(run(docs)) == rows_of(run(changed)) == rows_of(run(docs.repartition(7)))


def test_odd_texts_and_empty_tables(odd_docs, no_docs, work):
    rows = run(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    for i in (0, 1, 2):
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0.0
    assert rows_of(run(no_docs)) == []
    nothing = run(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    alone = run(odd_docs.withColumn("lang", F.lit("xx"))).collect()
    assert {r["lang_pred"] for r in alone} == {"xx", "und"}
