import public_tokenizers
import pytest
import tokenizers

from frameflow.llm import token_counts as counts
from frameflow.llm.wordcode import LONGEST, WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def brute(path, rows, limit=512):
    library = tokenizers.Tokenizer.from_file(path)
    made = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
    return sorted((repr(d), b, n, n > limit) for d, b, n in made)


def got(df):
    return sorted((repr(r[0]), *r[1:]) for r in df.collect())


@pytest.mark.parametrize("head", [0, 40, 1 << 17])
def test_whole_table_against_the_library(spark, sf, head):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    assert got(counts.token_counts(docs, BYTE, head=head)) == brute(BYTE, [tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_edge_cases(spark, edge_docs, no_docs, path, monkeypatch):
    monkeypatch.setattr(counts, "FLUSH", 2000)
    hard = ["a <|endoftext|> b", "x" * 5000, "x" * 5000 + " y", "\t\ta  b \n\n c ", "Ünï " * 3000, "é É", "　中文 字", "don't stop... 12,345"]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(hard, 100)), "doc_id bigint, text string")).selectExpr("*", "1 as number", "2 as parts", "3 as n", "4 as id")
    assert got(counts.token_counts(docs, path, head=20)) == brute(path, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert counts.token_counts(no_docs, path).count() == 0


def test_the_head_is_bounded(spark):
    pieces = spark.range(1000).selectExpr("cast(cast(id as string) as binary) as part", "cast(1000 / (id + 1) + 1 as bigint) as n", "1L as pieces")
    for head in (0, 1, 10, 100, 5000):
        assert pieces.where(pieces["n"] >= counts._cut(pieces, head)).count() <= head
    assert pieces.where(pieces["n"] >= counts._cut(pieces, 5000)).count() == 1000


def test_memory_of_an_encoder_is_bounded_in_bytes():
    code = WordEncoder(BYTE, limit=20_000)
    code.encode([f"{'abcdefghij' * 20_000}{k}" for k in range(5)])
    assert code.held == 0 or max(map(len, code)) <= LONGEST
    code.encode([f"w{k}" for k in range(3000)])
    assert code.held <= 20_000 + 400 and sum(map(len, code)) <= 20_000
