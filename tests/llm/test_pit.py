import hashlib
import random

import pytest

from frameflow.llm import pit
from frameflow.llm.pit import features_at, point_in_time

VERSIONS = "k string, event bigint, arrival bigint, expiry bigint, id bigint, `payload` string, winner int"


def brute(versions, k, t):
    """(event, id) of the winner, or None."""
    usable = [v for v in versions if k is not None and t is not None and v[0] == k and None not in v[1:4] and v[1] <= t and v[2] <= t < v[3]]
    best = min(usable, key=lambda v: (-v[1], v[2], v[4] is None, -(v[4] or 0)), default=None)
    return best and (best[1], best[4])


@pytest.mark.parametrize(("bits", "long"), [(1, 30), (2, 500), (6, 40), (1, 900)])
def test_winners_against_brute_force(spark, bits, long, monkeypatch):
    """Short and long lives, a hot key, ties, nulls, and versions that are never usable; small nodes and hot ones."""
    monkeypatch.setattr(pit, "HOT", 8)
    rng = random.Random(long)
    versions = [(rng.choice("aaaabcd"), e := rng.randrange(1000), e + rng.randrange(-5, 60), e + rng.randrange(long), k % 90, "p", 1) for k in range(400)]
    versions += [(None, 1, 1, 900, 1, "p", 1), ("a", None, 1, 900, 1, "p", 1), ("a", 1, None, 900, 1, "p", 1), ("b", 1, 1, None, 1, "p", 1), ("c", 5, 2, 999, None, "p", 1), ("e", 7, 9, 9, 3, "p", 1)]
    versions += versions[:20]
    asks = [(rng.choice(["a", "a", "b", "c", "d", "e", "none", None]), rng.randrange(-20, 1100) if rng.random() < 0.95 else None) for _ in range(300)]
    asks += asks[:30]
    out = point_in_time(spark.createDataFrame(versions, VERSIONS).repartition(5), spark.createDataFrame(asks, "k string, t bigint").selectExpr("*", "1 as row", "2 as `__row`", "3 as level", "4 as id", "5 as winner"), "k", "t", "event", "arrival", "expiry", "id", bits)
    got = sorted((repr(r["k"]), repr(r["t"]), repr(r["winner_"] and (r["winner_"]["event"], r["winner_"]["version"]))) for r in out.collect())
    assert got == sorted((repr(k), repr(t), repr(brute(versions, k, t))) for k, t in asks)


def test_an_ask_that_visits_all_of_a_tree(spark):
    """Bounds that rule nothing out: every second leaf has expired, the others start later, and only the last is usable."""
    versions = [("a", 1000 - k, 2000 if k % 2 else 0, 4000 if k % 2 else 1100, k, "p", 1) for k in range(200)] + [("a", 0, 0, 5000, 999, "p", 1)]
    out = point_in_time(spark.createDataFrame(versions, VERSIONS), spark.createDataFrame([("a", 1500)], "k string, t bigint"), "k", "t", "event", "arrival", "expiry", "id", bits=1)
    assert out.first()["winner"]["version"] == 999


def test_contract_on_small_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(k, 1) for k in (None, *range(45), 5, 5)], "doc_id bigint, quality int").selectExpr("*", "'a' as source", "9 as t")
    got = features_at(edge_docs, labels)
    docs = edge_docs.collect()

    def parts(doc):
        return [int(hashlib.sha256(str(doc).encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]

    versions = []
    for r in docs:
        if r["doc_id"] is not None and r["source"] is not None:
            a, b, c, _ = parts(r["doc_id"])
            versions.append((r["source"], a % 20000, a % 20000 - 60 + b % 300, a % 20000 + c % 900, r["doc_id"]))
    want = []
    for doc in (None, *range(45), 5, 5):
        t = None if doc is None else parts(doc)[3] % 20000
        source = min((r["source"] for r in docs if doc is not None and r["doc_id"] == doc and r["source"] is not None), default=None)
        won = brute(versions, source, t)
        age = won and t - won[0]
        row = next((r for r in docs if won and r["doc_id"] == won[1]), None)
        fresh = won is not None and age <= 60
        want.append((doc, t, won and won[1], age, "none" if won is None else "fresh" if fresh else "stale", row["n_chars"] if fresh else None, row["lang"] if fresh else None))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert features_at(no_docs, labels).where("status <> 'none'").count() == 0
    assert features_at(edge_docs, labels.where("false")).count() == 0


def test_no_more_than_a_share_of_asks_meets_at_one_copy(spark, monkeypatch):
    monkeypatch.setattr(pit, "HOT", 16)
    asks = spark.range(1600).selectExpr("id as row", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else cast(id as string) end as k")
    rows = spark.createDataFrame([("hot", 1), ("2", 2)], "k string, v int")
    met = pit.meet(asks, rows, ["k"], "row", 1600)
    assert met.count() == 1600 and met.where("v = 1").count() == 534 and met.where("v = 2").count() == 1
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
