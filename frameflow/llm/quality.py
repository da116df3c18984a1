"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Words and word shapes (letters, digits and marks, runs collapsed; a word that repeats the one before counts as a shape of
its own) have sparse ternary index vectors by hashed bucket. A word's vector is its index vector plus the normalised sum of its neighbours' in the training sample. A document is the
mean over all its words of their vectors and of their shapes' vectors. A tanh layer and a logistic one give a logit; a
temperature, fitted on a part of the training sample that the network didn't see, calibrates it.

The fit uses at most ``MAX_SAMPLE`` labelled rows, those with the smallest hashes of their ids; the model's size is
fixed. Their whole texts stay on the executors: the driver gets one sum of neighbours, and a pooled vector a row.
Scoring covers every row and whole texts. Defined results: a null or empty text pools to zeros and gets a score; a very
long text is pooled whole, in its task; repeated rows get equal scores; an empty table gives an empty result; with one class or no labels the score is the smoothed share of label 1; null labels are
ignored; extra columns of either table are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import claim, materialise
from frameflow.llm.held_out import held_out, learnable

MAX_SAMPLE = 8_000
PARTS = 8  # tasks that sum the neighbours of the sample's words
SLABS = 64  # parts of those sums, added up by Spark
BUCKETS, SHAPES, DIMS, NONZERO, HIDDEN = 1 << 15, 1 << 12, 64, 6, 32
REMEMBERED = 300_000  # words of at most LONGEST bytes
LONGEST = 64
_KINDS = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))
AGAIN = zlib.crc32(b"=") % SHAPES
_RUN = re.compile(rb"(.)\1+", re.S)


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse ternary rows: NONZERO entries of +1 or -1 each."""
    rng, out = np.random.default_rng(seed), np.zeros((n, DIMS), np.float32)
    for k in range(NONZERO):
        out[np.arange(n), rng.integers(0, DIMS, n)] = rng.choice((-1, 1), n) if k % 2 else 1
    return out


_keys: dict[bytes, tuple[int, int]] = {}


def keys(word: bytes) -> tuple[int, int]:
    """The buckets of a word and of its shape."""
    got = _keys.get(word)
    if got is None:
        got = (zlib.crc32(word.lower()) % BUCKETS, zlib.crc32(_RUN.sub(rb"\1", word.translate(_KINDS))) % SHAPES)
        if len(word) <= LONGEST:
            if len(_keys) > REMEMBERED:
                _keys.clear()
            _keys[word] = got
    return got


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pooled(self, text: str | None) -> np.ndarray:
        return pool(text, self.words, self.shapes)

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits((pooled - self.mean) / self.scale, self.w1, self.b1, self.w2, self.b2) / self.temperature, -500, 500)))


def pool(text: str | None, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    flat = (text or "").encode("utf-8", "surrogatepass").split()
    count = Counter(flat)
    if not count:
        return np.zeros(2 * DIMS + 1, np.float32)
    at = np.array([keys(w) for w in count], np.int64)
    n = np.fromiter(count.values(), np.float32, len(count))
    total = n.sum()
    shape_n = np.bincount(at[:, 1], n, SHAPES)
    shape_n[AGAIN] += sum(map(eq, flat, islice(flat, 1, None)))  # words that repeat the one before
    used = np.flatnonzero(shape_n)
    return np.concatenate([n @ words[at[:, 0]] / total, shape_n[used].astype(np.float32) @ shapes[used] / total, [np.log1p(total)]]).astype(np.float32)


def logits(x: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float) -> np.ndarray:
    return np.tanh(x @ w1 + b1) @ w2 + b2


def neighbours(texts: list[str | None], window: int = 2) -> np.ndarray:
    """Each word bucket's sum of its neighbours' index vectors: whole numbers, so that sums don't depend on their order."""
    index = index_vectors(BUCKETS, 11)
    context = np.zeros_like(index)
    for i in range(0, len(texts), 200):
        ids = [np.array([keys(w)[0] for w in (t or "").encode("utf-8", "surrogatepass").split()] + [-1] * window, np.int64) for t in texts[i : i + 200]]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        for d in range(1, window + 1):
            a, b = ids[:-d], ids[d:]
            a, b = a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]
            pairs, n = np.unique(np.concatenate([a * BUCKETS + b, b * BUCKETS + a]), return_counts=True)
            np.add.at(context, pairs // BUCKETS, index[pairs % BUCKETS] * n[:, None].astype(np.float32))
    return context


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Index vectors plus each word's normalised sum of its neighbours' index vectors."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return index_vectors(BUCKETS, 11) + np.sqrt(NONZERO) * context / np.maximum(norm, 1e-6)


def fit(words: np.ndarray, shapes: np.ndarray, x: np.ndarray, labels: np.ndarray, epochs: int = 60, seed: int = 5) -> Model:
    """A model from the pooled vectors ``x`` of labelled documents."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rate = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(rate / (1 - rate)))
    w1, b1, w2, b2 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), prior
    if not 0 < y.sum() < len(y):
        return Model(words, shapes, mean, scale, w1, b1, w2, b2, 1.0)
    z = (x - mean) / scale
    order = rng.permutation(len(z))
    check, train = order[: len(z) // 5], order[len(z) // 5 :]
    w2 = rng.normal(0, 0.1, HIDDEN)
    params = [w1, b1, w2, np.array([b2])]
    m, v, t, best = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, None
    for _ in range(epochs):
        mixed = rng.permutation(train)
        for k in range(0, len(train), 128):
            rows = mixed[k : k + 128]
            a = np.tanh(z[rows] @ params[0] + params[1])
            g = (1 / (1 + np.exp(-(a @ params[2] + params[3]))) - y[rows]) / len(rows)
            back = np.outer(g, params[2]) * (1 - a * a)
            grads = [z[rows].T @ back + 1e-3 * params[0], back.sum(0), a.T @ g + 1e-3 * params[2], np.array([g.sum()])]
            t += 1
            for p, q, m_, v_ in zip(params, grads, m, v, strict=True):
                m_ += 0.1 * (q - m_)
                v_ += 0.001 * (q * q - v_)
                p -= 0.003 * (m_ / (1 - 0.9**t)) / (np.sqrt(v_ / (1 - 0.999**t)) + 1e-8)
        out = logits(z[check], params[0], params[1], params[2], float(params[3][0]))
        loss = np.logaddexp(0, -out * (2 * y[check] - 1)).mean() if len(check) else 0.0
        if best is None or loss < best[0]:
            best = (loss, [p.copy() for p in params], out)
    _, params, out = best
    heats = np.geomspace(0.2, 5, 80)
    losses = [np.logaddexp(0, -out / h * (2 * y[check] - 1)).mean() if len(check) else 0.0 for h in heats]
    return Model(words, shapes, mean, scale, params[0], params[1], params[2], float(params[3][0]), float(heats[int(np.argmin(losses))]) if len(check) else 1.0)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, max_sample: int = MAX_SAMPLE) -> Model:
    """A model of ``labels[label]``, learnt from at most ``max_sample`` labelled rows outside the held-out fold."""
    rows = labels.where(learnable(F.col("doc_id"), folds) & F.col(label).isNotNull()).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y"))
    place = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    share = int(min(1.0, 2 * max_sample / max(1, rows.count())) * (1 << 30))  # so that tasks send some two samples in all
    picked = F.broadcast(rows.where(place < share).orderBy(place, "__id", "__y").limit(max_sample))
    sample = materialise(docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("__id")).select("doc_id", F.col("__y").alias("y"), "text"), "sample")

    def sums(batches):
        import pyarrow as pa

        total = np.zeros((BUCKETS, DIMS), np.float32)
        for batch in batches:
            total += neighbours(batch.column(0).to_pylist())
        slabs = total.reshape(SLABS, -1)
        used = np.flatnonzero(slabs.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([slabs[k].tobytes() for k in used], pa.binary())], names=["slab", "sums"])

    def add(key, rows):
        import pyarrow as pa

        total = sum(np.frombuffer(p.as_buffer(), np.float32) for p in rows.column("sums"))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slab", "sums"])

    # SLABS rows at most, of the model's size together, however many tasks have summed
    parts = sample.coalesce(PARTS).select("text").mapInArrow(sums, "slab int, sums binary").groupBy("slab").applyInArrow(add, "slab int, sums binary").toArrow()
    context = np.zeros((SLABS, BUCKETS * DIMS // SLABS), np.float32)
    for k, p in zip(parts.column("slab").to_pylist(), parts.column("sums"), strict=True):
        context[k] = np.frombuffer(p.as_buffer(), np.float32)
    context = context.reshape(BUCKETS, DIMS)
    words, shapes = word_vectors(context), index_vectors(SHAPES, 12)
    held = docs.sparkSession.sparkContext.broadcast((words.astype(np.float32), shapes))

    def pooled(batches):
        import pyarrow as pa

        for batch in batches:
            x = [pool(t.as_py(), *held.value).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])

    got = sorted((tuple(r) for r in sample.mapInArrow(pooled, "doc_id bigint, y int, x binary").collect()), key=lambda r: (r[0], r[1], bytes(r[2])))
    x = np.array([np.frombuffer(r[2], np.float32) for r in got], np.float32).reshape(len(got), 2 * DIMS + 1)
    return fit(words.astype(np.float32), shapes, x, np.array([r[1] for r in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (score >= threshold) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        own = held.value
        claim("quality", _keys)
        for batch in batches:
            x = np.array([own.pooled(t.as_py()) for t in batch.column(1)], np.float32).reshape(batch.num_rows, 2 * DIMS + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(x).astype(np.float64))], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id bigint, score double")
    return scored.select(F.col("doc_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row, by a model learnt outside the held-out fold."""
    return score(docs, train(docs, labels, label, folds), threshold=threshold).select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", "predicted")
