import mmap
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from frameflow.llm import queries
from frameflow.llm.packing import HarmonicBins, pack, padding
from frameflow.llm.token_output import DacSegment, dac_encode, read_tokens, segment_places, token_round_trip, write_tokens
from frameflow.llm.wordcode import WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ENCODERS = {p: WordEncoder(p, limit=300) for p in (BYTE, WORD)}
FRESH = {p: tokenizers.Tokenizer.from_file(p) for p in (BYTE, WORD)}
HARD = [chr(c) for c in (0, 0x1C, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x130, 0x3A3, 0x3C2, 0x301, 0x338, 0xDF, 0xE9, 0x212A, 0x4E2D, 0x1F44D)]
HARD += [" ", "  ", "\n", "\r", "\t", "\x0b", "\x0c", "a", "B", "'s", "'LL", "!", "...", "|", "12", "_", "H" + chr(0x331), "I" + chr(0x307), "W" + chr(0x30A), "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"]


def plain(path, text):
    return FRESH[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_hard_texts_encode_as_the_library_does(path):
    rng = random.Random(9)
    texts = ["".join(rng.choice(HARD) for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    texts += ["a" + c + " " + c + "b" + c + c + c + "d " + c for c in map(chr, range(0x3100))]
    got = ENCODERS[path].encode(texts)
    wrong = [t for t, g, e in zip(texts, got, FRESH[path].encode_batch(texts, add_special_tokens=False)) if np.frombuffer(g, "<u4").tolist() != e.ids]
    assert not wrong


def test_a_token_is_read_by_seeking(spark, sf, tmp_path):
    write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), str(tmp_path / "t"), BYTE, segment_tokens=3000)
    want = {r["start"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read_tokens(spark, str(tmp_path / "t")).collect()}
    ids, seen = [i for k in sorted(want) for i in want[k]], 0
    for part in sorted(Path(tmp_path / "t").glob("part-*")):
        with open(part, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            for at, n in segment_places(data):
                with memoryview(data) as view, view[at : at + n] as cell:
                    segment = DacSegment(cell)
                    for i in (0, len(segment) // 2, len(segment) - 1):
                        assert segment[i] == ids[seen + i]
                    seen += len(segment)
                    del segment
    assert seen == len(ids)


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" \n\t\r\x0b\x1c\x85\xa0　aB1'.s!é,ab|:", max_size=30)), max_size=6))
def test_remembered_chunks_encode_as_whole_texts(path, texts):
    got = ENCODERS[path].encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(path, t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), a=st.integers(0, 1500), b=st.integers(0, 1500))
def test_dac_gives_any_id_and_any_slice(ids, a, b):
    segment = DacSegment(dac_encode(np.array(ids, np.uint32)))
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert segment.slice(a, b).tolist() == ids[a:b]
    assert [segment[i] for i in range(a, min(b, a + 40))] == ids[a : min(b, a + 40)]
    with pytest.raises(IndexError):
        segment[len(ids)]


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(words=st.lists(st.text(alphabet="aBéÉßİıſΣςñŉǅŐ.,!'’", min_size=1, max_size=8), max_size=8))
def test_words_of_letters(path, words):
    text = " ".join(words)
    assert np.frombuffer(ENCODERS[path].encode([text])[0], "<u4").tolist() == plain(path, text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_output_against_the_library(spark, sf):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = sorted(tuple(r) for r in queries.op2_token_codes(spark, sf).collect())
    want, start = [], 0
    for doc in sorted(docs):
        ids = [*plain(BYTE, docs[doc]), 2]
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_token_output_of_edge_cases(spark, edge_docs, no_docs):
    got = token_round_trip(edge_docs, BYTE).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((r["doc_id"] or 0, len(plain(BYTE, r["text"])) + 1) for r in edge_docs.collect())
    spans = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert token_round_trip(no_docs, BYTE).count() == 0


@settings(max_examples=80, deadline=None)
@given(sizes=st.lists(st.integers(1, 700), max_size=60))
def test_harmonic_bins(sizes):
    bins = HarmonicBins(256)
    done = [s for k, n in enumerate(sizes) for s in bins.add(k, np.arange(n, dtype="<u4").tobytes())]
    full = [sum(len(p[2]) // 4 for p in s) for s in done]
    done += list(bins.close())
    lengths = [sum(len(p[2]) // 4 for p in s) for s in done]
    assert all(256 - 3 < n <= 256 for n in full) and all(n <= 256 for n in lengths)
    for k, n in enumerate(sizes):
        pieces = sorted((p[1], p[2]) for s in done for p in s if p[0] == k)
        assert b"".join(x for _, x in pieces) == np.arange(n, dtype="<u4").tobytes()
    assert padding(np.array(lengths, int), 256) <= 0.01 * 256 * len(lengths)


def test_packing_against_the_library(spark, sf, edge_docs, no_docs):
    docs = {r[0]: [*plain(WORD, r[1]), 2] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op7_packing(spark, sf).collect()
    for doc, ids in docs.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    lengths = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        lengths.append(at)
    assert max(lengths) <= 4096 and padding(np.array(lengths)) <= 0.01 * sum(lengths)
    assert pack(edge_docs, WORD).selectExpr("sum(length)").first()[0] == sum(len(plain(WORD, r["text"])) + 1 for r in edge_docs.collect())
    assert pack(no_docs, WORD).count() == 0
