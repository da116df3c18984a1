"""Log-bilinear language model with noise-contrastive estimation, and a smoothed unigram base.

Counts of all words of the training fold are made by Spark, stay a table and grow with the input. The ``WORDS`` most
frequent words, the end, and one target for all other words are the model's targets. The prediction of a position is the
sum of its three earlier words' vectors, each times the matrix of its place; a target's score is the prediction times the
target's vector, plus a bias. All of that is trained by noise-contrastive estimation on mini-batches of real text:
the windows of all positions of the training fold, against noise sampled from the base. Positions are written as one
number each and stay on the executors, where windows are made from them: each ``TRAINER`` windows are one group, which takes mini-batch steps from the common parameters,
and after each round a parameter becomes its mean over the groups that moved it. More text means more groups, and each
takes as many steps as one would alone. Only averaged parameters reach the driver; their size is that of the targets.

For normalised probabilities the targets are dealt into classes by bisecting their vectors, smaller ones for the most
frequent eighth; a target as likely as a whole class would be is a class of its own. Class vectors are trained in
the same way, and a token's probability is its class's softmax times the softmax among the class's own targets: two
batched matrix products, whose logarithms sum to one over all targets. A word that isn't a target has the probability of
the target for others times its share of them by the base's counts.

The counts of at most ``LOCAL`` words, the most frequent, go to the workers; rarer words meet their counts in a join. Each document is
one summary row and one row a distinct rare word there, under a number unique to it, so repeated rows stay apart.
Defined results: a null, empty or blank text is its end alone; a very long text is scored in pieces that keep their
context; a null id is learnt from nowhere and not held out; with no training rows the base is uniform over one unseen
word; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import materialise
from frameflow.llm.held_out import held_out, learnable

WORDS, CLASSES = 16_384, 128
LOCAL = 100_000
EVERY, WINDOWS = 1, 1_000_000  # one position in EVERY is learnt from (all of them), and at least WINDOWS where there are as many
DRAWN = 1 << 18  # positions, or so, whose windows are made at once
TRAINER = 1_000_000  # windows that one group learns from
CHUNK = 4096  # windows that stay together
PLACES, DIMS = 3, 16
BATCH, NOISE, ROUNDS, STEPS, CLASS_STEPS, RATE = 2048, 128, 2, 450, 250, 0.15  # steps a round, or one pass where that is more
ADD = 0.1
SLICE = 1 << 17  # positions scored at once
NEAR = 512  # predictions whose scores stay in a processor's cache
HASHED = 1 << 18  # distinct words of a partition, at most, that a hash join holds
PART = 4 << 20  # bytes of texts whose words are told apart at once; a longer text is one part


def _parts(texts, most: int) -> Iterator:
    """Slices of an Arrow column of some ``most`` bytes, or of one longer text."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield texts.slice(first, last - first)
        first = last


def _words(texts) -> tuple:
    """The words of an Arrow column of texts, lower-cased (ASCII) and end to end, and how many each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    if pc.all(real, min_count=0).as_py():
        return flat.cast(pa.binary()), np.diff(ends)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real).cast(pa.binary()), np.diff(before[ends])


def _numbers(words, known) -> np.ndarray:
    """The place of each word in the Arrow array ``known``, -1 for others."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (lower-cased ASCII, bytes) and c over whole texts; the end isn't among them."""

    def work(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for part in _parts(batch.column(0), 4 * PART):
                words, counts = pc.value_counts(_words(part)[0]).flatten()
                yield pa.RecordBatch.from_arrays([words, counts], names=["word", "c"])

    parts = docs.select(text_col).mapInArrow(work, "word binary, c bigint")
    return parts.select(F.col("word").cast("string").alias("word"), "c").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> list:
    """Some ``most`` of the most frequent words, in order. Frequencies are graded by 64ths of their binary logarithm, so
    that the grades are few and no task sends more than its share of the words; of the last grade, which has more words
    than there is room for, those with the smallest hashes are taken."""
    grade, place = F.floor(F.log2("c") * 64), F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    total, wanted = 0, F.lit(False)
    for r in sorted(counts.groupBy(grade.alias("g")).count().collect(), key=lambda r: -r["g"]):
        if total + r["count"] > most:
            wanted = wanted | ((grade == r["g"]) & (place < int((most - total) / r["count"] * (1 << 30))))
            break
        wanted = grade >= r["g"]
        total += r["count"]
    return sorted(counts.where(wanted).collect(), key=lambda r: (-r["c"], r["word"]))


def _chain(ids: np.ndarray, lengths: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of these ``lengths`` laid end to end, each after ``PLACES`` starts and before its end, and the positions
    that are targets."""
    firsts = np.cumsum(lengths + PLACES + 1) - lengths - 1
    spread = lambda n: np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    flat = np.full(len(ids) + len(lengths) * (PLACES + 1), start, np.int64)
    flat[spread(lengths)], flat[firsts + lengths] = ids, end
    return flat, spread(lengths + 1)


def sampled_windows(docs: DataFrame, own: dict[bytes, int], share: float, groups: int) -> DataFrame:
    """grp, ids, share and w: chunks of text, dealt to ``groups`` by their checksums, and their windows as bytes (the
    ``PLACES`` words before, nearest first, and the target); each position is drawn with probability ``share``.

    Only ``ids`` are written, one number a position: windows, four times as long, are made where they are asked for."""
    n, held = len(own), docs.sparkSession.sparkContext.broadcast(own)

    def work(batches):
        import pyarrow as pa

        known = pa.array(list(held.value), pa.binary())
        number = np.array([*held.value.values(), n])  # -1, of others, is the last
        for batch in batches:
            for part in _parts(batch.column(0), 8 * DRAWN):
                words, lengths = _words(part)
                flat, at = _chain(number[_numbers(words, known)], lengths, n + 2, n + 1)
                flat = flat.astype(_kind(n))
                chunks = [flat[at[k] - PLACES : at[min(k + CHUNK, len(at)) - 1] + 1].tobytes() for k in range(0, len(at), CHUNK)]
                grp = [zlib.crc32(c) % groups for c in chunks]
                yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int32()), pa.array(chunks, pa.binary())], names=["grp", "ids"])

    @F.pandas_udf("binary")
    def windows(ids: pd.Series) -> pd.Series:
        return ids.map(lambda c: windows_in(c, n, share).tobytes())

    return materialise(docs.select("text").mapInArrow(work, "grp int, ids binary"), "windows").select("grp", "ids", F.lit(float(share)).alias("share"), windows("ids").alias("w"))


def windows_in(ids: bytes, n: int, share: float) -> np.ndarray:
    """A row for each position drawn of a chunk, whose first ``PLACES`` numbers are context; starts (n + 2) are no targets."""
    flat = np.frombuffer(ids, _kind(n)).copy()
    starts = flat == n + 2
    at = np.flatnonzero(~starts[PLACES:])
    if share < 1:
        at = at[np.random.default_rng(zlib.crc32(ids)).random(len(at)) < share]
    flat[starts] = n + 1
    return np.stack([flat[PLACES - i : len(flat) - i] for i in (*range(1, PLACES + 1), 0)], 1).take(at, 0)


def _kind(n: int) -> str:
    """How ``n`` words, the target for others, the end and the start are stored."""
    return "<u2" if n + 3 <= 1 << 16 else "<i4"


@dataclass
class Model:
    """``places``: a table of context vectors for each place; targets are in order of their classes, ``starts`` says where
    each class begins; ``order`` gives a target's place there."""

    places: list[np.ndarray]
    class_vectors: np.ndarray
    class_bias: np.ndarray
    vectors: np.ndarray
    bias: np.ndarray
    starts: np.ndarray
    order: np.ndarray

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms; ``contexts``: a row a token, nearest word first."""
        out = np.empty(len(targets))
        for k in range(0, len(targets), SLICE):
            out[k : k + SLICE] = self._slice(contexts[k : k + SLICE], targets[k : k + SLICE])
        return out

    def _slice(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        q = _with_ones(sum(t.take(contexts[:, i], 0) for i, t in enumerate(self.places)))
        place, bounds = self.order[targets], [*self.starts.tolist(), len(self.bias)]
        cls = np.repeat(np.arange(len(self.starts)), np.diff(bounds))[place]
        longest = _longest(q[:, :-1])
        out = _chosen(q, np.column_stack([self.class_vectors, self.class_bias]), cls, longest)
        by = np.argsort(cls.astype(np.uint16), kind="stable")
        ends, q, place, inside = np.searchsorted(cls[by], np.arange(len(bounds))), q.take(by, 0), place[by], np.empty(len(by))
        for c in np.flatnonzero(np.diff(ends)).tolist():
            rows, a, b = slice(ends[c], ends[c + 1]), bounds[c], bounds[c + 1]
            inside[rows] = _chosen(q[rows], np.column_stack([self.vectors[a:b], self.bias[a:b]]), place[rows] - a, longest) if b > a + 1 else 0.0
        out[by] += inside
        return out


def _with_ones(q: np.ndarray) -> np.ndarray:
    """A last column of ones, which meets the bias."""
    out = np.ones((len(q), q.shape[1] + 1), np.float32)
    out[:, :-1] = q
    return out


def _longest(x: np.ndarray) -> float:
    return float(np.einsum("ij,ij->i", x, x).max(initial=0)) ** 0.5


def _chosen(q: np.ndarray, rows: np.ndarray, which: np.ndarray, longest: float) -> np.ndarray:
    """The log-softmax of one row of ``rows`` (vectors and bias) a prediction, none longer than ``longest``, for a few at a
    time, so that scores stay in a processor's cache. Where no score can be far from the largest bias, none is taken off
    before the exponentials."""
    out, columns, ones = np.empty(len(q)), np.ascontiguousarray(rows.T, np.float32), np.ones(len(rows), np.float32)
    columns[-1] -= columns[-1].max()
    small = longest * _longest(rows[:, :-1]) - columns[-1].min() < 60
    for k in range(0, len(q), NEAR):
        scores = q[k : k + NEAR] @ columns
        if not small:
            scores -= scores.max(1, keepdims=True)
        picked = scores[np.arange(len(scores)), which[k : k + NEAR]].astype(np.float64)
        np.exp(scores, out=scores)
        out[k : k + NEAR] = picked - np.log((scores @ ones).astype(np.float64))
    return out


@dataclass
class Table:
    """Parameters under Adagrad, of single precision; ``rows`` names the rows of a sparse gradient, which may repeat."""

    both: np.ndarray  # a parameter's value and the squares seen lie side by side, so that one gather reads both

    @classmethod
    def of(cls, value: np.ndarray) -> Table:
        return cls(np.stack([value.astype(np.float32), np.full(value.shape, 1e-3, np.float32)], 1))

    @property
    def value(self) -> np.ndarray:
        return self.both[:, 0]

    @property
    def seen(self) -> np.ndarray:
        return self.both[:, 1]

    def copy(self) -> Table:
        return Table(self.both.copy())

    def take(self, rows: np.ndarray) -> np.ndarray:
        return self.both.reshape(-1, self.both.shape[2]).take(2 * rows, 0)

    def step(self, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        if rows is None:
            self.seen[:] += grad * grad
            self.value[:] += RATE * grad / np.sqrt(self.seen)
            return
        order = np.argsort(rows.astype(np.uint16) if len(self.both) <= 1 << 16 else rows, kind="stable")  # a radix sort
        sorted_ = rows[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        ids, total = sorted_[first], _sums(grad, order, first)
        both = self.both.take(ids, 0)
        both[:, 1] += total * total
        total *= np.float32(RATE)
        total /= np.sqrt(both[:, 1])
        both[:, 0] += total
        _put(self.both.reshape(len(self.both), -1), ids, both.reshape(len(both), -1))


def _put(table: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """``table[ids] = rows``, a row being one item."""
    whole = f"V{table.itemsize * table.shape[1]}"
    np.put(table.view(whole).ravel(), ids, rows.view(whole).ravel())


def _sums(x: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of the rows ``x[order]``. Most runs are one row, which is taken as it is; the others' are added two columns
    at a time, as real and imaginary part."""
    times = np.diff(first, append=len(order))
    out, several = x.take(order[first], 0), np.flatnonzero(times > 1)
    if len(several):
        runs, many = times[several], x.take(order[np.repeat(times > 1, times)], 0)
        if odd := x.shape[1] % 2:
            many = np.column_stack([many, np.zeros(len(many), x.dtype)])
        sums = np.add.reduceat(many.view(np.complex64), np.cumsum(runs) - runs).view(np.float32)
        _put(out, several, np.ascontiguousarray(sums[:, :-1]) if odd else sums)
    return out


def _contrast(q: np.ndarray, targets: Table, target: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, by_prediction: bool = True) -> np.ndarray | None:
    """One step of ``targets`` (vectors, and the bias as the last column) by the noise-contrastive objective, and the
    gradient by prediction, where it is asked for; ``q`` has a last column of ones. All tokens share ``noise``; what was drawn twice counts twice."""
    noise = np.sort(noise)
    first = np.flatnonzero(np.concatenate([[True], noise[1:] != noise[:-1]]))
    noise, times = noise[first], np.diff(first, append=len(noise))
    mine, others = targets.take(target), targets.take(noise)
    shifted = -others.T
    shifted[-1] += log_noise[noise]
    with np.errstate(over="ignore"):
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, mine) - log_noise[target]))  # the probability that a token is taken for noise
        down = q @ shifted  # and that noise is taken for a token
        np.exp(down, out=down)
    down += 1
    np.reciprocal(down, out=down)
    times = times.astype(np.float32)[:, None]
    by_q = None if not by_prediction else up[:, None] * mine[:, :-1] - down @ (times * others[:, :-1])
    targets.step(np.concatenate([up[:, None] * q, -times * (down.T @ q)]), np.concatenate([target, noise]))
    return by_q


def _batches(windows: np.ndarray, steps: int, rng: np.random.Generator):
    at = len(windows)
    for _ in range(steps if len(windows) else 0):
        if at + BATCH > len(windows):
            mixed, at = windows.take(rng.permutation(len(windows)), 0), 0
        yield mixed[at : at + BATCH].astype(np.int64)
        at += BATCH


def word_steps(tables: list[Table], windows: np.ndarray, base: np.ndarray, seed: int) -> None:
    """One round of a group: at least one pass over its ``windows``, against noise from ``base``."""
    words, mixing, targets = tables
    rng, totals, log_noise = np.random.default_rng(seed), np.cumsum(base) / base.sum(), np.log(NOISE * base).astype(np.float32)
    for w in _batches(windows, max(STEPS, -(-len(windows) // BATCH)), rng):
        contexts, target = w[:, :PLACES].ravel(), w[:, PLACES]
        noise = np.minimum(np.searchsorted(totals, rng.random(NOISE)), len(base) - 1)
        before = words.take(contexts).reshape(len(w), -1)
        by_q = _contrast(_with_ones(before @ mixing.value), targets, target, noise, log_noise)
        by_words = (by_q @ mixing.value.T).reshape(len(contexts), -1)
        mixing.step(before.T @ by_q)
        words.step(by_words, contexts)


def class_steps(tables: list[Table], windows: np.ndarray, fixed: tuple, seed: int) -> None:
    """Class vectors by the same objective, at least one pass too; ``fixed``: context tables, each target's class, the classes' shares."""
    contexts, cls, share = fixed
    rng, totals, log_share = np.random.default_rng(seed), np.cumsum(share) / share.sum(), np.log(NOISE * share).astype(np.float32)
    for w in _batches(windows, max(CLASS_STEPS, -(-len(windows) // BATCH)), rng):
        noise = np.minimum(np.searchsorted(totals, rng.random(NOISE)), len(share) - 1)
        _contrast(_with_ones(sum(t.take(w[:, i], 0) for i, t in enumerate(contexts))), tables[0], cls[w[:, PLACES]], noise, log_share, by_prediction=False)


def groups_of(windows: DataFrame, n: int):
    """``run`` for ``train``: every group of ``windows`` takes ``step`` from the tables given, on the executors; a row of a
    table becomes its mean over the groups that moved it."""
    spark = windows.sparkSession

    def run(step, tables: list[Table], fixed, seed: int) -> list[Table]:
        held = spark.sparkContext.broadcast((tables, fixed))

        def work(key, rows):
            import pyarrow as pa

            start, fixed = held.value
            own = [t.copy() for t in start]
            share = rows.column("share")[0].as_py()
            step(own, np.concatenate([windows_in(c, n, share) for c in sorted(rows.column("ids").to_pylist())]), fixed, seed + key[0].as_py())
            out = []
            for k, (t, old) in enumerate(zip(own, start, strict=True)):
                moved = np.flatnonzero((t.seen != old.seen).any(1))
                both = np.concatenate([t.value[moved], t.seen[moved]], 1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(both.ravel()), both.shape[1]).cast(pa.list_(pa.float32()))
                out.append(pa.table([pa.array(np.full(len(moved), k, np.int32)), pa.array(moved, pa.int32()), lists], ["k", "row", "v"]))
            return pa.concat_tables(out)

        moved = windows.select("grp", "ids", "share").groupBy("grp").applyInArrow(work, "k int, row int, v array<float>")
        width = 2 * max(t.value.shape[1] for t in tables)
        sums = moved.groupBy("k", "row").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)]).toArrow()
        held.unpersist()
        which, rows, times = (sums.column(c).to_numpy() for c in ("k", "row", "n"))
        for k, t in enumerate(tables):
            w, mine = t.value.shape[1], which == k
            for i in range(w):
                t.value[rows[mine], i] = sums.column(f"v{i}").to_numpy()[mine] / times[mine]
                t.seen[rows[mine], i] = sums.column(f"v{w + i}").to_numpy()[mine] / times[mine]
        return tables

    return run


def _halves(vectors: np.ndarray, ids: np.ndarray, times: int) -> list[np.ndarray]:
    """``ids`` in 2 ** times classes of equal size, by bisecting along the direction of greatest spread."""
    if not times or len(ids) < 2:
        return [ids]
    x = vectors[ids] - vectors[ids].mean(0)
    along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
    order = ids[np.argsort(along, kind="stable")]
    return _halves(vectors, order[: len(order) // 2], times - 1) + _halves(vectors, order[len(order) // 2 :], times - 1)


def _classes(vectors: np.ndarray, base: np.ndarray, classes: int) -> list[np.ndarray]:
    """Targets as likely as a class would be, one by one; the rest in ``classes`` classes, half of them of the most likely
    eighth, so that softmaxes of few targets are those that are asked for most."""
    rest = np.argsort(-base, kind="stable")
    alone, rest = rest[base[rest] >= 1 / classes], rest[base[rest] < 1 / classes]
    times = max(0, min(classes, len(base)).bit_length() - 1)
    if len(rest) < 32 * classes:
        parts = [(rest, times)]
    else:
        parts = [(rest[: len(rest) // 8], times - 1), (rest[len(rest) // 8 :], times - 1)]
    return [*alone[:, None], *(g for ids, k in parts if len(ids) for g in _halves(vectors, ids, k))]


def train(run, base: np.ndarray, classes: int = CLASSES, seed: int = 3) -> Model:
    """A model of targets 0 to len(base) - 1, whose base probabilities are the noise. A context is a target or, where the
    end would be, the start. ``run(step, tables, fixed, seed)`` returns the tables after a round over the windows."""
    rng, n = np.random.default_rng(seed), len(base)
    tables = [
        Table.of(rng.normal(0, 0.1, (n, DIMS))), Table.of(np.tile(np.eye(DIMS) * 0.5, (PLACES, 1))),
        Table.of(np.column_stack([rng.normal(0, 0.1, (n, DIMS)), np.log(base)])),
    ]
    for k in range(ROUNDS):
        tables = run(word_steps, tables, base, (seed + k) << 32)
    words, mixing, targets = (t.value for t in tables)
    contexts, vectors = [np.ascontiguousarray(words @ p) for p in mixing.reshape(PLACES, DIMS, DIMS)], targets[:, :-1]
    groups = _classes(vectors, base, classes)
    in_order = np.concatenate(groups)
    starts = np.cumsum([0, *map(len, groups)])[:-1]
    order = np.empty(n, np.int64)
    order[in_order] = np.arange(n)
    cls = np.searchsorted(starts, order, "right") - 1
    share = np.bincount(cls, base, len(groups))
    first = np.array([np.average(vectors[g], axis=0, weights=base[g]) for g in groups])
    by_class = run(class_steps, [Table.of(np.column_stack([first, np.log(share)]))], (contexts, cls, share), (seed + ROUNDS) << 32)[0].value
    small = lambda x: np.ascontiguousarray(x, np.float32)
    return Model([small(t) for t in contexts], small(by_class[:, :-1]), small(by_class[:, -1]), small(vectors[in_order]), small(targets[in_order, -1]), starts, order)


def score(docs: DataFrame, folds: int = 10, targets: int = WORDS, classes: int = CLASSES, local: int = LOCAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    learn = rows.where(learnable(F.col("id"), folds))
    counts = materialise(word_counts(learn), "counts")
    ends = learn.count()
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, kinds = words + ends, kinds + (ends > 0)
    often = [(r["word"].encode("utf-8", "surrogatepass"), r["c"]) for r in frequent(counts, local)]
    often_c = np.array([c for _, c in often], np.int64)
    n = min(targets, len(often))
    own = {w: k for k, (w, _) in enumerate(often[:n])}
    space = tokens + ADD * (kinds + 1)
    other_c, other_kinds = words - int(often_c[:n].sum()), kinds - n - (ends > 0)
    other_space = other_c + ADD * (other_kinds + 1)
    base = np.concatenate([(often_c[:n] + ADD) / space, [other_space / space], [(ends + ADD if ends else ADD) / space]])
    base /= base.sum()
    share = min(1.0, max(1 / EVERY, WINDOWS / max(1, tokens)))
    model = train(groups_of(sampled_windows(learn, own, share, max(1, round(tokens * share / TRAINER))), len(own)), base, classes)
    held = spark.sparkContext.broadcast(([w for w, _ in often], np.log10(often_c + ADD), model))
    log_space, log_other, end_part = np.log10(space), np.log10(other_space), np.log10(ends + ADD)
    whole = "struct<id: bigint, n_tokens: bigint, n_known: bigint, base: double, model: double>"  # null where a row is a word's

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ctx = TaskContext.get()
        columns, names = ["row", "word", "tf", "doc"], ["id", "n_tokens", "n_known", "base", "model"]
        row, (words, logs, model) = (ctx.partitionId() if ctx else 0) << 33, held.value
        known, logs = pa.array(words, pa.binary()), np.append(logs, 0.0)  # -1, of rarer words, is the last
        long, real = pa.int64(), pa.float64()
        nothing_of = pa.struct([pa.field(c, t) for c, t in zip(names, (long, long, long, real, real), strict=True)])

        def rows_of(docs, texts):
            nonlocal row
            found, lengths = _words(texts)
            ids = _numbers(found, known)
            flat, at = _chain(np.where((ids >= 0) & (ids < n), ids, n), lengths, n + 1, n + 1)
            log = np.empty(len(at))
            for k in range(0, len(at), SLICE):
                part = at[k : k + SLICE]
                log[k : k + SLICE] = model.log_probabilities(np.stack([flat[part - i] for i in range(1, PLACES + 1)], 1), flat[part])
            own = np.add.reduceat(log, np.cumsum(lengths + 1) - lengths - 1) / np.log(10)
            doc, log = np.repeat(np.arange(len(lengths)), lengths), logs[ids]
            of = lambda which, w=None: np.bincount(doc[which], None if w is None else w[which], len(lengths))
            rare, near = np.flatnonzero(ids < 0), np.flatnonzero(ids >= n)
            unknown = of(rare)
            base = np.bincount(doc, log, len(lengths)) + end_part - (lengths + 1) * log_space
            others = of(near, log) - (of(near) + unknown) * log_other
            numbers, nothing = np.arange(row, row + len(lengths)), np.zeros(len(lengths), np.int64)
            row += len(lengths)
            yield pa.RecordBatch.from_arrays([
                pa.array(numbers), pa.array([b"\0" + k.to_bytes(8, "big") for k in numbers.tolist()], pa.binary()), pa.array(nothing),
                pa.StructArray.from_arrays([docs.cast(long), pa.array(lengths + 1, long), pa.array(lengths - unknown + (ends > 0), long), pa.array(base, real), pa.array(own + others, real)], names),
            ], names=columns)
            kinds = found.take(pa.array(rare)).dictionary_encode()
            pairs, tf = np.unique(doc[rare] * max(1, len(kinds.dictionary)) + kinds.indices.to_numpy(), return_counts=True)
            which, kind = np.divmod(pairs, max(1, len(kinds.dictionary)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[which]), kinds.dictionary.take(pa.array(kind)), pa.array(tf, long), pa.nulls(len(tf), nothing_of)], names=columns)

        for batch in batches:
            at = 0
            for texts in _parts(batch.column(1), PART):
                yield from rows_of(batch.column(0).slice(at, len(texts)), texts)
                at += len(texts)

    parts = rows.mapInArrow(work, f"row bigint, word binary, tf bigint, doc {whole}")
    known = counts.select(F.col("word").cast("binary").alias("word"), F.log10(F.col("c") + ADD).alias("log"))
    if kinds <= HASHED * int(spark.conf.get("spark.sql.shuffle.partitions")):  # distinct words: a partition's share is bounded, and needs no sorting
        known = known.hint("shuffle_hash")
    met = parts.join(known, "word", "left")
    log = F.when(F.col("tf") > 0, F.col("tf") * F.coalesce("log", F.log10(F.lit(ADD)))).otherwise(0.0)
    done = met.groupBy("row").agg(
        *[F.max(f"doc.{c}").alias(c) for c in ("id", "n_tokens", "base", "model")], (F.sum(F.when(F.col("log").isNotNull(), F.col("tf")).otherwise(0)) + F.max("doc.n_known")).alias("n_known"), F.sum(log).alias("rare"),
    )
    return done.select(F.col("id").alias(id_col), held_out(F.col("id"), folds).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), (F.col("base") + F.col("rare")).alias("base_score"), (F.col("model") + F.col("rare")).alias("score"))
