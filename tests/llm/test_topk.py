import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameflow.llm import queries, topk


def plain(rows, k=5, every=50):
    ok = {}
    out = []
    cands = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, v in cands:
        if i % every == 0:
            ok[i] = min(ok.get(i, v), v)
    for q, v in ok.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in cands if c != q)[:k]
        out += [(q, n, c, -s) for n, (s, c) in enumerate(scored, 1)]
    return sorted(out)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.op4_topk(spark, sf).collect())) == plain(rows)


ROWS = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.5]), (8, [0.5, -1.0, 9.0]), (9, [0.0, 0.0]), (50, [-1.0, 0.5]), (None, [5.0, 5.0]), (0, [0.5, 0.5]), (10, [])]


@pytest.mark.parametrize("limit", [1 << 20, 16])
def test_edge_cases_and_blocks_of_queries(spark, monkeypatch, limit):
    monkeypatch.setattr(topk, "QUERY_BYTES", limit)
    v = spark.createDataFrame(ROWS, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as id", "2 as score", "3 as rank")
    got = sorted(map(tuple, topk.top_k(v.where("vec_id % 50 = 0"), v).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == plain(ROWS)
    assert topk.top_k(v.where("false"), v).count() == 0 and topk.top_k(v.where("vec_id % 50 = 0"), v.where("false")).count() == 0


@pytest.mark.parametrize("slice_bytes", [1 << 30, 3000, 200])
def test_large_query_sets_meet_all_slices(spark, monkeypatch, slice_bytes):
    """Many blocks of queries and slices of candidates, with repeated rows and a third of all rows alike."""
    monkeypatch.setattr(topk, "QUERY_BYTES", 256)
    monkeypatch.setattr(topk, "SLICE_BYTES", slice_bytes)
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 4)]) for i in rng.integers(0, 900, 300)] + [(7, [0.25, 0.5, 0.5, 0.0])] * 150
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    asked = v.where("vec_id % 30 = 0")
    got = topk.top_k(asked, v, k=4)
    assert "BroadcastExchange" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == plain(rows, 4, 30)


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(1, 900), dims=st.integers(1, 20), spread=st.sampled_from([2, 300, 1 << 40]))
def test_pruning_keeps_the_exact_best(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    rows, ids = rng.integers(-spread, spread, (n, dims)), rng.permutation(n)
    q = rng.integers(-min(spread, 1 << 18), min(spread, 1 << 18), dims)
    best = topk.Best(5)
    for k in range(0, n, 250):
        topk.Block(ids[k : k + 250], rows[k : k + 250], int(np.abs(q).max())).search(3, q, best)
    exact = [(-sum(int(a) * int(b) for a, b in zip(q, r)), int(i)) for i, r in zip(ids, rows) if i != 3]
    assert list(zip((-best.scores).tolist(), best.ids.tolist())) == sorted(exact)[:5]
