import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm.topk import _grid, shard_top, top_k


def brute(rows, asks, k=5):
    kept = []
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(256 * x) for x in v]))
    out = {}
    for q, a in {(q, tuple(a)) for q, a in kept if asks(q)}:
        out.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b)), d) for d, b in kept if d != q)
    return {q: [(d, -s) for s, d in sorted(found)[:k]] for q, found in out.items()}


def answer(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("n, dims, block", [(700, 16, 64), (300, 3, 4096), (4, 8, 2)])
def test_equals_brute_force(work, n, dims, block):
    pick = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.round(pick.normal(0, 0.2, (n, dims)), 2))]
    rows[n // 2 :] = [(i, rows[i % 5][1]) for i, _ in rows[n // 2 :]]  # many ties
    df = work.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = answer(top_k(df, F.col("vec_id") % 10 == 0, block_rows=block))
    assert got == brute(rows, lambda q: q % 10 == 0)


def test_nulls_odd_vectors_and_names(work):
    good = [(0, [0.5, 0.25]), (1, [0.1, 0.9]), (2, [1.0, -1.0]), (2, [0.3, 0.3]), (10, [0.0, 0.0])]
    odd = [(3, None), (None, [1.0, 1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0])]
    df = work.createDataFrame(
        [(k, v, 1, "x") for k, v in good + odd], "vec_id long, embedding array<float>, id int, score string"
    )
    asks = lambda q: q % 10 == 0
    assert answer(top_k(df, F.col("vec_id") % 10 == 0)) == brute(good + odd, asks)
    assert answer(top_k(df.where("1 = 0"), F.col("vec_id") % 10 == 0)) == {}
    assert answer(top_k(df.where("vec_id = 0"), F.col("vec_id") % 10 == 0)) == {}


def test_probing_drops_vectors_early_and_stays_exact():
    pick = np.random.default_rng(4)
    # Few strong components: most vectors cannot compete once these are added up.
    vectors = pick.integers(-3, 4, (3000, 24)).astype(float)
    strong = pick.integers(0, 24, (3000, 2))
    vectors[np.arange(3000)[:, None], strong] += 200
    ids = np.arange(3000)
    for q, found, scores in shard_top(vectors[:40], ids[:40], vectors, ids, 5):
        exact = vectors @ vectors[q]
        exact[q] = -np.inf
        best = np.lexsort((ids, -exact))[:5]
        assert found.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()


def test_parts_of_queries_and_shards_are_merged(work):
    pick = np.random.default_rng(11)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.round(pick.normal(0, 0.2, (400, 6)), 1))]
    rows += [(i, v[::-1]) for i, v in rows[:40]] + rows[40:80]  # ids with two vectors, rows that come twice
    rows += [(500, [0.5] * 9), (510, []), (520, [90.0, -3e4]), (530, [1.0])]  # of other lengths, beyond two bytes
    df = work.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = answer(top_k(df, F.col("vec_id") % 10 == 0, block_rows=16, query_bytes=1500, shard_bytes=9000))
    assert got == brute(rows, lambda q: q % 10 == 0)


def test_copies_of_queries_are_never_broadcast(work):
    rows = [(i, [0.25 * (i % 7), 0.5]) for i in range(300)]
    df = work.createDataFrame(rows, "vec_id long, embedding array<float>")
    before = work.conf.get("spark.sql.autoBroadcastJoinThreshold")
    work.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = top_k(df, F.col("vec_id") % 50 == 0)
        got = answer(found.select("*"))
        found.collect()
    finally:
        work.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute(rows, lambda q: q % 50 == 0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows, queries", [(100, 2), (51_282, 1026), (10**6, 10**6), (15 * 10**6, 300_000), (10**9, 10), (0, 0)])
def test_tasks_are_bounded_and_copies_few(rows, queries):
    down, across = _grid(72 * rows, 72 * queries, queries, 10_000, 256 << 20, 64 << 20)
    assert 8 * 72 * queries <= down * (64 << 20) and 8 * 72 * rows <= across * (256 << 20)
    needed = -(-8 * 72 * queries // (64 << 20)) * rows + -(-8 * 72 * rows // (256 << 20)) * queries
    assert down * rows + across * queries <= max(10 * rows, 2 * needed + rows + queries)
