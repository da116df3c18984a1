"""What the models learn from, against plain learners over collected rows."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from frameflow.llm import langid, quality

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def learnable(doc_id, folds=5):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds != 0


def learnt_counts(monkeypatch, df):
    kept = {}
    monkeypatch.setattr(langid, "fit", lambda pieces, counts, rounds=0: kept.setdefault("counts", counts) and langid.Model([], pieces, np.zeros((0, 0))))
    langid.train(df, VOCABULARY)
    return {lang: +c for lang, c in kept["counts"].items()}


def brute_counts(rows):
    out = {}
    for doc, text, lang in rows:
        if learnable(doc) and lang is not None and lang != "und":
            out.setdefault(lang, Counter()).update(w for w in langid._WORD.findall((text or "").lower()) if len(w) <= langid.FIT_LETTERS)
    return out


def test_language_learns_each_rows_own_label(spark, monkeypatch):
    rows = [(2, "hallo welt", "de"), (2, "hello world", "en"), (2, None, "fr")] + [(1, "alpha", "en")] * 50
    rows += [(4, "x" * 500 + " short", "en"), (5, "held out or not", "en"), (None, "no id", "de"), (7, "none", None), (8, "none", "und")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    want = brute_counts(rows)
    assert want["en"]["alpha"] == 50 and learnt_counts(monkeypatch, df) == want


def test_language_sample_is_bounded_however_often_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_SAMPLE", 10)
    rows = [(1, "wort", "de") for k in range(300)] + [(k, "word", "en") for k in range(300)]
    got = learnt_counts(monkeypatch, spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4))
    assert got == {"de": Counter({"wort": 10}), "en": Counter({"word": 10})}


def test_language_counts_of_a_whole_table(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert learnt_counts(monkeypatch, df) == brute_counts([tuple(r) for r in df.select("doc_id", "text", "lang").collect()])


def test_quality_learns_from_all_labelled_rows_outside_the_fold(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [(r["doc_id"], texts[r["doc_id"]], r["quality"]) for r in labels.collect() if learnable(r["doc_id"]) and r["quality"] is not None and r["doc_id"] in texts]
    words = quality.word_vectors(quality.neighbours([t for _, t, _ in rows])).astype(np.float32)
    shapes = quality.index_vectors(quality.SHAPES, 12)
    assert len(rows) > 30 and np.allclose(model.words, words)
    rows = sorted(((d, y, quality.pool(t, words, shapes)) for d, t, y in rows), key=lambda r: (r[0], r[1], r[2].tobytes()))
    want = quality.fit(words, shapes, np.array([r[2] for r in rows]), np.array([r[1] for r in rows]))
    some = np.array([r[2] for r in rows])
    assert np.allclose(model.scores(some), want.scores(some), atol=1e-5)


def test_quality_sums_are_added_up_by_spark(spark, monkeypatch):
    """The driver gets one sum of neighbours in all, not one a task; the model is the same from any number of files."""
    from frameflow.llm import quality

    docs = spark.createDataFrame([(k, f"alpha beta w{k % 7} gamma {k % 3}") for k in range(120)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id bigint, quality int")
    sizes, fetch = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: sizes.append(fetch(df)) or sizes[-1])
    one, many = quality.train(docs.coalesce(1), labels), quality.train(docs.repartition(40), labels)
    assert (one.words == many.words).all() and (one.w1 == many.w1).all()
    assert len(sizes) == 2 and all(0 < t.nbytes < 1.1 * quality.BUCKETS * quality.DIMS * 4 for t in sizes)


def test_idle_workers_keep_no_words(spark, sf):
    def kept(batches):
        import pyarrow as pa

        from frameflow.llm import common

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, common._remembered.get("langid", [])))])], names=["n"])

    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(4)
    model = langid.fit(langid.Pieces(["a", "b", "e"]), {"x": Counter(["abe"]), "y": Counter(["bea"])}, rounds=1)
    assert langid.score(docs, model).where("lang_pred = 'x'").count() > 0
    assert {r["n"] for r in docs.select("doc_id").mapInArrow(kept, "n bigint").collect()} == {0}
