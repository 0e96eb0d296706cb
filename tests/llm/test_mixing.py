import math
from collections import Counter

import pytest
from llm_helpers import rows_of, words_of
from pyspark.sql import functions as F

from tidewire.llm.mixing import mix, mix_rates


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by handing the excess of full sources on, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if rest * weight[s] / total > most * sizes[s]}
        if not full:
            return target | {s: rest * weight[s] / total for s in free}
        target |= {s: float(most * sizes[s]) for s in full}
        rest -= sum(most * sizes[s] for s in full)
        free -= full
    return target


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_targets_equal_repeated_resharing(work, n):
    rows = [(i, "w " * (1 + (i * 37) % (3 + 40 * (i % n))), f"é{i % n}" if i % n else None) for i in range(60)]
    docs = work.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words_of(text))
    expected = shares(sizes)
    by_id = {r[0]: r for r in rows}
    for row in mix_rates(docs).collect():
        source = by_id[row["doc_id"]][2]
        assert row["size"] == len(words_of(by_id[row["doc_id"]][1]))
        assert row["source_size"] == sizes[source]
        assert math.isclose(row["target"], expected[source], rel_tol=1e-12)
        rate = row["target"] / row["source_size"]
        assert row["copies"] in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9)) and row["copies"] <= 3


def test_taken_words_come_near_the_targets(work):
    docs = work.range(20_000).selectExpr("id AS doc_id", "repeat('a ', 10 + id % 7) AS text", "concat('s', id % 5) AS source")
    for source in range(5):
        got = mix_rates(docs).where(f"doc_id % 5 = {source}").selectExpr("sum(size * copies) AS taken", "max(target) AS target").first()
        assert abs(got["taken"] - got["target"]) < 0.05 * got["target"]


def test_taken_words_come_near_the_targets_of_real_texts(work):
    """Few documents a source, some of them with most of its words."""
    docs = work.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rated = mix_rates(docs).join(docs.select("doc_id", "source"), "doc_id")
    off = rated.selectExpr("source", "size * copies AS taken", "target").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target")
    )
    shares = sorted(r["taken"] / r["target"] for r in off.collect())
    assert len(shares) == docs.select("source").distinct().count() and shares[0] > 0.9 and shares[-1] < 1.1


def test_mix_repeats_rows_and_reruns_agree(work, odd_docs):
    mixed = mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert rows_of(mixed) == rows_of(mix(odd_docs))
    copies = sum(r["copies"] for r in mix_rates(odd_docs).collect())
    assert mixed.count() == copies and set(rows_of(mixed)) <= set(rows_of(odd_docs))


def test_empty_table(no_docs):
    assert mix_rates(no_docs).count() == 0 and mix(no_docs).count() == 0


def test_sources_without_words_get_nothing(work):
    docs = work.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert rows_of(mix_rates(docs), "target", "copies") == [(0.0, 0), (0.0, 0)]
