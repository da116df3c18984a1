import zlib

import pytest

from frameflow.llm import queries
from frameflow.llm.sharding import shard_by_bytes


def check(rows, texts, n_shards, largest):
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(n_shards))
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    total = sum(r["size"] for r in rows)
    for s in range(n_shards):
        assert abs(sum(r["size"] for r in by.get(s, [])) - total / n_shards) <= 2 * largest
    order = [r["doc_id"] or 0 for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    return order


def test_query(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op8_sharding(spark, sf).collect()
    order = check(rows, texts, 16, max(len((t or "").encode()) + 1 for _, t in texts))
    assert order == sorted(order) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


@pytest.mark.parametrize("rows", [
    [(7, "same")] * 3000,  # one key, one text
    [(None, "x" * 50)] * 500 + [(k, "y") for k in range(500)],
    [(k, None if k % 3 else "z" * (k % 40)) for k in range(-900, 900)],
    [(1, "a" * 5000), (2, "b")],
])
def test_hot_keys_nulls_and_ties(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as shard", "2 as size", "3 as id", "4 as range")
    check(shard_by_bytes(df, 4).collect(), rows, 4, max(len(t or "") + 1 for _, t in rows))


def test_empty_table(spark, no_docs):
    assert shard_by_bytes(no_docs).count() == 0
