import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from frameflow.llm import line_dedup, queries
from frameflow.llm.line_dedup import dedup_lines, drop_bitmaps

BLANK = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=1, min_docs=10):
    """By (doc_id, text): the lines kept."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    docs = {(d, t) for d, t in rows}
    seen = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            seen.setdefault(key(line), set()).add((d, t))
    often = {k for k, v in seen.items() if len(k) >= min_chars and len(v) >= min_docs}
    return {(d, t): [line for line in (t or "").split("\n") if key(line) not in often] for d, t in docs}


def test_query_against_brute_force(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    kept = plain(rows)
    want = {d: (len((t or "").split("\n")), len((t or "").split("\n")) - len(kept[d, t]), hashlib.sha256("\n".join(kept[d, t]).encode()).hexdigest()) for d, t in rows}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op3_line_dedup(spark, sf).collect()} == want


@pytest.mark.parametrize("least", [(1, 10), (2, 3), (1, 2)])
def test_edge_cases(spark, edge_docs, no_docs, least):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    want = sorted((d or 0, "\n".join(k)) for (d, t) in rows for k in [plain(rows, *least)[d, t]])
    got = dedup_lines(edge_docs, min_chars=least[0], min_docs=least[1])
    assert sorted((r["doc_id"] or 0, r["kept_text"]) for r in got.collect()) == want
    assert set(edge_docs.columns) < set(got.columns) | {"kept_text"} and {r["bits"] for r in got.select("bits").collect()} == {7}
    assert dedup_lines(no_docs).count() == 0


def test_first_occurrence_stays(spark):
    docs = spark.createDataFrame([(2, "a\nb"), (1, "x\nA "), (3, "a\na")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["kept_text"] for r in dedup_lines(docs, min_docs=2, keep="first").collect()}
    assert got == {1: "x\nA ", 2: "b", 3: ""}


def test_long_documents_and_sparse_bitmaps(spark):
    lines = [f"only {k}" for k in range(5000)]
    lines[130] = lines[4999] = "common"
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "common\nother")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in dedup_lines(docs, min_docs=2).collect()}
    assert got == {1: (5000, 2), 2: (2, 1)}
    bits = {r["__doc"]: [(b["word"], b["mask"]) for b in r["bits"]] for r in drop_bitmaps(docs, min_docs=2).collect()}
    assert bits[1] == [(2, 1 << 2), (78, 1 << 7)] and bits[2] == [(0, 1)]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_lines_that_subdivide_their_range(spark, monkeypatch, keep):
    monkeypatch.setattr(line_dedup, "SAMPLE", 8)
    texts = [f"own {k}\ncommon" + ("\nhalf" if k % 2 else "") + ("\npair" if k in (5, 77) else "") for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    parts = line_dedup.ranged(line_dedup.occurrences(docs))
    assert parts.where("sub > 0").select("sub").distinct().count() > 1
    got = {r["doc_id"]: r["kept_text"].split("\n") for r in dedup_lines(docs, min_docs=2, keep=keep).collect()}
    first = {"common": 0, "half": 1, "pair": 5} if keep == "first" else {}
    assert got == {k: [line for line in t.split("\n") if line.startswith("own") or first.get(line) == k] for k, t in enumerate(texts)}


def test_texts_are_split_once_and_no_range_is_shuffled_again(spark, sf):
    seen = line_dedup.occurrences(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = line_dedup.ranged(seen).withColumn("n", F.sum(F.lit(1)).over(Window.partitionBy("range", "sub", "h1", "h2")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_repeated_rows_are_split_once(spark):
    text = "one\ntwo\none"
    rows = [(1, text)] * 3000 + [(None, "null id\ntwo")] * 20 + [(1, "other text\ntwo"), (2, "two"), (2, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    seen = line_dedup.occurrences(line_dedup.once(docs, "doc_id", "text"))
    assert seen.count() == 3 + 2 + 2 + 1  # an empty line has no key
    kept = plain(rows, 1, 3)
    want = {(d, t, "\n".join(kept[d, t])) for d, t in set(rows)}
    assert {(r["doc_id"], r["text"], r["kept_text"]) for r in dedup_lines(docs, min_docs=3).collect()} == want
    assert dedup_lines(docs, min_docs=3).count() == len(rows)


def test_no_rows_are_made_in_the_driver(spark, sf):
    """They would start Python workers on the executors, which stay through the stages after."""
    plan = line_dedup.ranged(line_dedup.occurrences(spark.read.parquet(f"{sf}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" not in plan
