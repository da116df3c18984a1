import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameflow.llm import trie
from frameflow.llm.trie import DIGEST, LoserTree, conversation_trie, ordered_turns, run_of

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """The contract, by a dictionary of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(t)] for c, t in own.items()}
    full = {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + own[c][h:] for c in own}
    members, ends = {}, {}
    for c, t in sorted(full.items()):
        ends.setdefault(tuple(t), []).append(c)
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        text = p[-1][1] if p else ""
        saved[p] = (len(members[p]) - 1) * len([w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]) + sum(saved[k] for k in below)
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, m in members.items()
    )


def rows_of(rng, n, deep):
    """Conversations that share first turns, copies of whole ones, and long ones."""
    rows = []
    for c in range(n):
        kind = rng.random()
        turns = [f"t{k} same words" for k in range(deep)] if kind < 0.3 else [f"q{rng.randrange(3)} x\ty" for _ in range(rng.randrange(deep + 1))]
        if 0.3 < kind < 0.5:
            turns = [f"t{k} same words" for k in range(rng.randrange(deep + 1))] + [f"own {c}"]
        rows += [(c, k, "user" if k % 2 else None, t) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize(("chunk", "deep"), [(64, 6), (2, 6), (3, 9), (1, 4)])
def test_trie_against_brute_force(spark, chunk, deep, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 7)
    rows = rows_of(random.Random(chunk), 90, deep)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(conversation_trie(df, chunk)) == brute(rows)


def test_whole_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(conversation_trie(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_edge_cases(spark):
    long = "wort " * 60_000
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 1, "a", long), (2, 0, "user", ""), (2, 0, "user", ""), (None, 3, "user", "nobody's"), (20, 0, "user", "base"), (21, 0, "x", "a"), (22, 0, "x", "a"), (22, 1, "x", "a"), (25, 7, "x", "a"), (-3, 0, "x", "a")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "2 as d", "3 as words", "4 as at", "5 as part", "6 as conv")
    mended = [r if r[0] != -3 else r for r in rows]
    want = brute([r for r in mended if r[0] != -3])
    assert got(conversation_trie(df.where("conv_id is null or conv_id >= 0"))) == want
    assert conversation_trie(df).where("depth = 0").first()["n_convs"] == 7
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turns_of_one_conversation_that_spans_ranges(spark):
    rows = [(5, k, "u", f"w{k}") for k in range(400)] + [(6, 0, "u", "x")]
    turns = sorted(map(tuple, ordered_turns(spark.createDataFrame(rows, SCHEMA)).select("conv", "pos").collect()))
    assert turns == [(5, k + 1) for k in range(400)] + [(6, 1)]
    assert got(conversation_trie(spark.createDataFrame(rows, SCHEMA), 16)) == brute(rows)


KEYS = st.lists(st.integers(0, 2), max_size=5).map(lambda k: b"".join(bytes([x]) * DIGEST for x in k))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(KEYS, st.integers(0, 9)), max_size=8), max_size=7))
def test_loser_tree_merges_and_tells_lcps(runs):
    rows = sorted(r for run in runs for r in run)
    tree = LoserTree([run_of([(*r, None, None) for r in run]) for run in runs])
    out = list(tree)
    assert [r[0][:2] for r in out] == rows
    for (a, _), (b, shared) in zip(out, out[1:]):
        units = [tuple(x[0][k : k + DIGEST] for k in range(0, len(x[0]), DIGEST)) for x in (a, b)]
        assert shared == next((k for k, (p, q) in enumerate(zip(*units)) if p != q), min(map(len, units)))


def test_shared_turns_are_not_compared_again():
    head = b"h" * DIGEST * 30
    runs = [run_of([(head + bytes([k, j]) * (DIGEST // 2), k, None, None) for k in range(200)]) for j in range(8)]
    tree = LoserTree(runs)
    assert len(list(tree)) == 1600
    assert tree.compared < 1600 * 8
