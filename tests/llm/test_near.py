import random

import numpy as np

import corpus_pipeline
from frameflow.llm import near

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def jaccard(a, b, n=5):
    sets = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def corpus():
    """Texts with copies of which 0 to 6 of 100 words or more are changed, and the texts' unrelated rest."""
    rng = random.Random(4)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 160))]
        for changed in (0, 0, 1, 1, 2, 3, 6):
            copy = list(base)
            for k in rng.sample(range(len(copy)), changed):
                copy[k] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_stage_against_brute_force(spark, sf):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_groups(spark, docs, sf).collect()}
    close = {(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8}
    assert not [p for p in close if kept.issuperset(p)]
    for gone in set(range(len(texts))) - kept:
        group, new = {gone}, {gone}
        while new:
            new = {k for p in close for k in p if group.intersection(p)} - group
            group |= new
        assert min(group) < gone


def test_rows_that_share_an_id_are_told_apart(spark, sf):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, one), (7, one), (7, two), (None, two), (None, one + " z"), (9, None), (None, ""), (3, one), (3, one)]
    docs = spark.createDataFrame([(k, t, "en", "a", 1, "x") for k, t in rows], DOCS + ", component string")
    kept = corpus_pipeline.near_duplicate_groups(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, one), (7, two), (9, "")]


def test_similar_is_exact_at_the_bound():
    a = np.arange(90, dtype=np.uint64)
    assert near.similar(a[:80], a[:64], 0.8) and not near.similar(a[:80], a[:63], 0.8)
    assert near.similar(a, a, 1.0) and not near.similar(a[:45], a[45:], 0.1)


def test_blocks_against_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) > 0.1], rng.integers(0, 1 << 62, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(60)]
    ids = rng.permutation(60).astype(np.int64)
    for first in (25, 60):
        others = range(first, 60) if first < 60 else range(60)
        want = {(i, j) for i in range(first) for j in others if i != j and near.similar(sets[i], sets[j], 0.8)}
        shared = near.shared_hashes(sets, first)
        assert all(shared[i, j - (first % 60)] == len(np.intersect1d(sets[i], sets[j])) for i in range(first) for j in others if i != j)
        group = {int(k): int(k) for k in ids}
        for _ in range(60):
            for i, j in want:
                group[int(ids[i])] = group[int(ids[j])] = min(group[int(ids[i])], group[int(ids[j])])
        got = near.block_links(ids, sets, first, 0.8)
        assert want and sorted(got) == sorted((a, b) for b, a in group.items() if a != b)
    assert near.block_links(ids[:1], sets[:1], 1, 0.8) == []


def test_copies_of_one_text_that_differ_from_each_other(spark, sf, monkeypatch):
    """Copies of one text, most of them less than 0.8 like each other, in more than one block a band."""
    monkeypatch.setattr(near, "BLOCK", 16)
    rng, base, texts = random.Random(9), [f"w{k}" for k in range(150)], []
    for _ in range(300):
        copy = list(base)
        for k in rng.sample(range(150), rng.randrange(2, 14)):
            copy[k] = f"v{rng.randrange(50_000)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], DOCS)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_groups(spark, docs, sf).collect())
    assert 1 < len(kept) < 300
    sets = [near.shingles(t) for t in texts]
    both = [(i, j) for i in kept for j in kept if i < j and near.similar(sets[i], sets[j], 0.8)]
    assert not [p for p in both if set(near.bands(sets[p[0]])) & set(near.bands(sets[p[1]]))]


def test_groups_are_complete(spark, sf):
    """Chains of which the first two and the last two texts are similar, but not the first and the last: all hang together."""
    rng, rows = random.Random(11), []
    for _ in range(150):
        first = [f"w{rng.randrange(9000)}" for _ in range(200)]
        second, third = list(first), None
        second[60] = "x"
        third = list(second)
        for k in (10, 110, 160):
            third[k] = f"v{k}"
        rows += [" ".join(w) for w in (first, second, third)]
    assert jaccard(rows[0], rows[1]) > 0.9 and jaccard(rows[1], rows[2]) > 0.8
    low = sum(jaccard(rows[k], rows[k + 2]) < 0.83 for k in range(0, 450, 3))
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(rows)], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_groups(spark, docs, sf).collect()}
    assert low > 100 and kept == set(range(0, 450, 3))


def test_two_groups_that_meet_late_become_one(spark):
    """Members of two groups, settled by their hubs, are similar across: the groups are one."""
    base = [f"w{k}" for k in range(200)]

    def changed(*at):
        return " ".join(f"v{k}" if k in at else w for k, w in enumerate(base))

    texts = [changed(*range(0, 200, 30)), changed(0, 30, 60), changed(0, 30), changed(5, 15), changed(5), changed(5, 15, 45, 75, 105, 135, 165)]
    close = {(i, j) for i in range(6) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8}
    group = list(range(6))
    for _ in range(6):
        for i, j in close:
            group[i] = group[j] = min(group[i], group[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    assert [r["component"] for r in near.near_copies(docs, "row").orderBy("row").collect()] == group


def test_recall_on_a_whole_table(spark):
    """Of all pairs of sf0.01 with a similarity of 0.8 or more, nine in ten at least are in one group, and groups hold no others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("row_number() over (order by doc_id) as row", "text")
    group = {r["row"]: r["component"] for r in near.near_copies(docs, "row").collect()}
    sets = {r["row"]: near.shingles(r["text"]) for r in docs.collect()}
    holders = {}
    for k, s in sets.items():
        for h in s.tolist():
            holders.setdefault(h, []).append(k)
    met = {(a, b) for ks in holders.values() if len(ks) < 60 for i, a in enumerate(ks) for b in ks[:i]}
    close = [(a, b) for a, b in met if near.similar(sets[a], sets[b], 0.8)]
    found = sum(group[a] == group[b] for a, b in close)
    print(f"recall {found} of {len(close)}")
    assert close and found >= 0.9 * len(close)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in close:
        root[max(find(a), find(b))] = min(find(a), find(b))
    blank = [k for k in sets if not len(sets[k])]
    assert all(find(k) == group[k] for k in sets if k not in blank) or found < len(close)
