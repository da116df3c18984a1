import hashlib
import re

import pytest

from frameflow.llm import decontam, queries

BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return [w for w in BETWEEN.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]


def plain(docs, items, size=13):
    windows = {}
    for item, t in items:
        w = words(t)
        if w and item is not None:
            n = min(size, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_query_against_brute_force(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = sorted((d, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), c) for d, n, h, f, c in plain(docs, items))
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in queries.op10_decontam(spark, sf).collect())
    assert got == want and any(r[5] for r in got) and not all(r[5] for r in got)


ITEMS = [(1, "alpha beta gamma"), (2, "Zeta"), (3, None), (4, " !!! "), (None, "delta epsilon"), (5, " ".join(f"w{k}" for k in range(20))), (6, "alpha beta gamma"), (10, "b1 b2"), (7, "x y")]
TEXTS = [(1, "Alpha, beta -- GAMMA delta " + " n" * 70), (2, None), (3, ""), (4, "zeta zeta"), (5, " ".join(f"w{k}" for k in range(3, 18))), (6, "w0 w1 w2"), (None, "x y x y x"), (6, "w0 w1 w2"), (8, "É zeta中 ß b1 b2" + " q" * 30)]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_edge_cases_in_a_row_and_by_join(spark, bound):
    docs = spark.createDataFrame([(*r, 1, "k") for r in TEXTS], "doc_id bigint, text string, item_id int, window string")
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id int, text string, doc_id int")
    got = decontam.contamination(docs, items, max_windows=bound).collect()
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted((key((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"])) for r in got), key=str) == sorted(map(key, plain(TEXTS, ITEMS)), key=str)
    kept = decontam.decontaminate(docs, items, max_windows=bound)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(d or 0 for d, *_, c in plain(TEXTS, ITEMS) if not c)
    spans = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, items, "spans", max_windows=bound).collect()}
    assert spans[4] == " " and spans[6] == "w0 w1 w2" and spans[1].split()[0] == "delta" and spans[2] is None


def test_spans_leave_all_other_characters(spark):
    items = spark.createDataFrame(ITEMS[:1], "item_id int, text string")
    texts = ["Hello, World!\n Alpha,beta GAMMA. Marks: A-b\n", "-- alpha beta gamma", "alpha beta gamma alpha  BETA gamma!", "alpha beta"]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id bigint, text string, hits int")
    got = decontam.decontaminate(docs, items, "spans").orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["Hello, World!\n . Marks: A-b\n", "-- ", " !", "alpha beta"]
    assert [r["hits"] for r in got] == [0, 1, 2, 3]


def test_a_long_text(spark):
    items = spark.createDataFrame(ITEMS[5:6], "item_id int, text string")
    text = " ".join(["filler"] * 60_000 + [f"w{k}" for k in range(20)])
    r = decontam.contamination(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), items).first()
    assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (60_020, 20, ["5"], False)


def test_empty_tables(spark, no_docs):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontam.contamination(no_docs, none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    r = decontam.contamination(one, none).first()
    assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (3, 0, [], False)
