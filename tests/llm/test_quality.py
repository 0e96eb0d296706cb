import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import real_docs, rows_of, words_of

from tidewire.llm import quality
from tidewire.llm.quality import BASE, Condition, fit_rules, judge, keep_good, learn_rules, text_stats


def brute(text):
    text = text or ""
    words = words_of(text)
    triples = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


ODD = [None, "", "\n\n", "a\na\n\na \na", "x\r\nx\r\nx", "é é é é", "𝒳# <b> | 漢", "a b c a b c", "a a a", "a a a a", "\n a\n a", "w " * 5_000, "q\n" * 500, "\x00 \x1f"]


def test_statistics_equal_plain_python(work):
    for texts in (ODD, ODD[::-1], [r["text"] for r in real_docs(work).collect()]):
        stats = text_stats(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert tuple(int(stats[c][i]) for c in BASE) == brute(text), text


def test_rules_are_found_grown_and_pruned():
    pick = np.random.default_rng(1)
    n = 3000
    x = {name: pick.random(n) for name in quality.FEATURES}
    bad = ((x["symbols_per_char"] > 0.8) & (x["upper_per_char"] > 0.5)) | (x["repeated_lines"] > 0.9)
    rules = learn_rules(x, bad, pick.random(n) < 0.33)
    caught = np.any([quality._covers(r, x, n) for r in rules], axis=0)
    assert caught[bad].mean() > 0.95 and caught[~bad].mean() < 0.01
    assert {c.feature for r in rules for c in r} <= {"symbols_per_char", "upper_per_char", "repeated_lines"}


@pytest.mark.parametrize("bad", [np.zeros(50, bool), np.ones(50, bool), np.arange(50) % 2 == 0])
def test_nothing_to_learn(bad):
    x = {name: np.ones(50) for name in quality.FEATURES}
    assert learn_rules(x, bad, np.arange(50) % 3 == 0) in ([], learn_rules(x, bad, np.arange(50) % 3 == 0))
    assert learn_rules({k: v[:0] for k, v in x.items()}, bad[:0], bad[:0]) == []


def test_verdict_is_one_ordered_expression(work):
    rules = [(Condition("symbols_per_char", True, 0.5), Condition("words_per_line", False, 2.0)), (Condition("upper_per_char", True, 0.9),)]
    text = str(quality.verdict(rules))
    assert text.count("CASE") == 1 and text.index("n_symbols") < text.index("n_upper")
    assert "true" in str(quality.verdict([]))


def test_learned_rules_on_labelled_documents(work):
    spark, sf = work, "/root/testdata/sf0.01"
    docs, labels = real_docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    rules = fit_rules(docs, labels)
    assert rules and rules == fit_rules(docs, labels)
    judged = judge(docs, rules).join(labels, "doc_id")
    good = judged.where("quality = 1 AND NOT base_failed")
    assert good.where("kept").count() >= 0.98 * good.count()
    bad = judged.where("quality = 0 AND NOT base_failed")
    assert bad.where("NOT kept").count() >= 0.8 * bad.count()
    kept = {r[0] for r in judge(docs, rules).where("kept").select("doc_id").collect()}
    assert {r["doc_id"] for r in keep_good(docs, rules).collect()} == kept
    assert keep_good(docs, rules).schema == docs.schema


def test_odd_texts_labels_and_empty_tables(work, odd_docs, no_docs):
    labels = work.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, 1), (None, 0, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    rules = fit_rules(odd_docs, labels)
    assert judge(odd_docs, rules).count() == odd_docs.count()
    for r in judge(odd_docs, rules).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert fit_rules(no_docs, labels) == [] and fit_rules(odd_docs, labels.where("1 = 0")) == []
    assert rows_of(judge(no_docs, [])) == [] and rows_of(keep_good(no_docs, [])) == []
    assert keep_good(odd_docs, []).columns == odd_docs.columns
