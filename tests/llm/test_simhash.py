import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from frameflow.llm import queries, simhash
from frameflow.llm.graph import connected_components


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(ids, fps):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = list(zip(ids, fps))
    for k, (a, x) in enumerate(pairs):
        for b, y in pairs[:k]:
            if (x ^ y).bit_count() <= 3:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r[0]: plain_fingerprint(r[1]) for r in docs}
    parts = plain_components(list(fps), list(fps.values()))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, sf).collect()}
    assert got == {d: (f"{fps[d]:016x}", parts[d]) for d in fps}


def clouds(seed, n, centres):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        x = rng.getrandbits(64)
        for _ in range(n // centres):
            out.add(x)
            for _ in range(rng.choice((1, 2, 3, 4, 5))):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


def test_many_shards_lose_no_link(spark):
    """Chains of near fingerprints and far ones, in shards of 32, against all pairs."""
    fps = clouds(3, 1500, 60)
    ids = list(range(100, 100 + len(fps)))
    random.Random(1).shuffle(ids)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame(list(zip(signed, ids)), "fp bigint, rep bigint")
    links = simhash.shard_links(table, len(fps), 3, shard=32)
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = plain_components(ids, fps)
    assert {i: got.get(i, i) for i in ids} == want and len(set(want.values())) > 40


@settings(max_examples=25, deadline=None)
@given(seed=st.integers(0, 10**6), centres=st.integers(1, 30))
def test_local_tree_links_all(seed, centres):
    fps = np.array(clouds(seed, 400, centres), np.uint64)
    old, simhash.BRUTE = simhash.BRUTE, 400
    try:
        groups = simhash.Groups(len(fps))
        for half in simhash.HALVES:
            simhash.link(fps, np.arange(len(fps)), np.zeros(0, np.int64), half, 1, 3, groups, np.random.default_rng(1))
    finally:
        simhash.BRUTE = old
    want = plain_components(list(range(len(fps))), fps.tolist())
    assert groups.roots().tolist() == [want[i] for i in range(len(fps))]


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(f"Word{k % 91}" for k in range(3000))
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "PIECE", 100)
    assert simhash.simhash(text) == whole == plain_fingerprint(text)


def test_edge_cases(spark, edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert sorted(r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, None)} == {5}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(500, 500), (600, 700), (700, 600)], "a bigint, b bigint"))
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {600: 600, 700: 600}
