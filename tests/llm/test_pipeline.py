"""The pipeline's rows against plain Python, stage by stage, and its stages on odd tables."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import rows_of, words_of
from test_jaccard import brute as components_of
from test_mixing import shares
from test_packing import ids_of
from test_quality import brute as stats_of
from test_secrets import base as secrets_of

from tidewire.llm import queries
from tidewire.llm.quality import FEATURES, _covers, fit_rules, text_stats

SF = "/root/testdata/sf0.001"


def masked(text):
    out, at = [], 0
    for start, _, end, kind in secrets_of(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def plain_rows(spark):
    """(doc_id, piece, length) of every piece that plain Python packs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = fit_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    stats = text_stats(pa.array([r["text"] for r in rows]))
    x = {k: stats[a] / np.maximum(stats[b], 1) for k, (a, b) in FEATURES.items()}
    rejected = np.any([np.zeros(len(rows), bool), *[_covers(r, x, len(rows)) for r in rules]], axis=0)
    kept = []
    for r, bad in zip(rows, rejected, strict=True):
        n, _, _, _, repeated = stats_of(r["text"])
        if n >= 50 and 100 * repeated <= 50 * n and not bad:
            kept.append(r)
    group = {d: c for d, _, c in components_of([(r["doc_id"], r["text"]) for r in kept])}
    kept = [r for r in kept if group[r["doc_id"]] == r["doc_id"]]
    for r in kept:
        r["text"] = masked(r["text"])
    sizes = Counter()
    for r in kept:
        sizes[r["source"]] += len(words_of(r["text"]))
    target = shares(sizes)
    out = []
    for r in kept:
        rate = min(3.0, target[r["source"]] / sizes[r["source"]])
        chance = int(hashlib.md5(f"{r['doc_id']}|mix".encode()).hexdigest()[:12], 16) / 16**12
        copies = math.floor(rate) + (chance < rate - math.floor(rate))
        n = len(ids_of(r["text"]))
        out += [(r["doc_id"], i, min(2048, n - at)) for _ in range(copies) for i, at in enumerate(range(0, n, 2048))]
    return sorted(out)


def test_rows_equal_plain_python(work):
    got = queries.QUERIES["pipeline"](work, SF).select("doc_id", "piece", "length", "sequence_id", "offset").collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in got) == plain_rows(work)
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bear_odd_and_empty_tables(work, odd_docs, no_docs, name, stage):
    odd = odd_docs.withColumnRenamed("size", "n_chars")
    out = stage(work, odd, SF)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == odd.columns
    if name == "near duplicates":
        rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
        ids = {d for d, _, c in components_of(rows) if d is not None and d == c}
        assert sorted(r["doc_id"] for r in out.where("doc_id IS NOT NULL").collect()) == sorted(ids)
        assert out.where("doc_id IS NULL").count() == odd.where("doc_id IS NULL").count()
    if name == "secret scans":
        assert out.count() == odd.count()
    assert rows_of(stage(work, no_docs.withColumnRenamed("size", "n_chars"), SF)) == []


def test_all_ten_and_the_pipeline_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)} | {"pipeline"}
    assert queries.ORACLES.keys() <= queries.QUERIES.keys()
