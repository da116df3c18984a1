"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary, lower-cased, have a probability in each language. A word's probability is the
sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over all its words, as no
piece crosses a word's start. The piece probabilities are learnt by expectation-maximisation, whose expected counts come
from the forward and backward sums. Words are scored in blocks of equal length for all languages at once, and remembered.

The fit uses at most ``MAX_SAMPLE`` rows of a language, those with the smallest hashes of their ids, each with its own text
and label, and of these the words of at most ``FIT_LETTERS`` letters; it learns every language present. Scoring covers
every row and whole texts, very long ones and words of any length too (these take some 0.5 ms a letter); an empty table
gives an empty result. Defined results: a text that is null or has no letter is 'und' with score 0; repeated rows count
each when they are learnt, and get equal results; equal scores go to the language that sorts first; with no labelled rows
every text is 'und'; extra columns are ignored. Of what is remembered between a task's texts no word has over ``SHORT`` letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.llm.common import claim, forget
from frameflow.llm.held_out import held_out, learnable

START = "▁"
UNDEFINED = "und"
MAX_PIECE = 16  # code points of the longest piece of the public vocabulary; the sums go by ``Pieces.longest``
MAX_SAMPLE = 400
FIT_LETTERS = 128
ROUNDS = 4
UNKNOWN = 1e-7  # of a character that no piece covers
SHORT = 40  # code points of a word whose sums of products don't underflow
REMEMBERED = 200_000
ROWS = 256
_WORD = regex.compile(r"\p{L}+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, lower-cased, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = (model.id_to_piece(k).lower() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    letters = regex.compile(rf"{START}?\p{{L}}*")
    return sorted({t for t in texts if t and letters.fullmatch(t)})


def _points(texts: list[str]) -> np.ndarray:
    """Code points of texts of one length, a row each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), -1)


@dataclass
class Pieces:
    """Piece numbers by rolling hashes of code points. Number 0 is the unknown character, -1 stands for no piece."""

    texts: list[str]
    keys: np.ndarray = field(init=False)
    numbers: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.texts), default=1)
        hashes = np.zeros(len(self.texts), np.uint64)
        for n in {len(t) for t in self.texts}:
            at = np.array([k for k, t in enumerate(self.texts) if len(t) == n])
            h = np.zeros(len(at), np.uint64)
            for column in _points([self.texts[k] for k in at]).T:
                h = self.roll(h, column)
            hashes[at] = h
        order = np.argsort(hashes)
        self.keys, self.numbers = hashes[order], order + 1

    @staticmethod
    def roll(h: np.ndarray, column: np.ndarray) -> np.ndarray:
        h = (h + column.astype(np.uint64) + np.uint64(1)) * _MUL
        return h ^ (h >> np.uint64(29))

    def ends(self, points: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
        """For each end j, the (start, piece number) of all pieces that end there, for a block of words."""
        n, width = points.shape
        open_: dict[int, np.ndarray] = {}
        for j in range(1, width + 1):
            open_ = {i: h for i, h in open_.items() if j - i <= self.longest} | {j - 1: np.zeros(n, np.uint64)}
            found = []
            for i in sorted(open_):
                h = open_[i] = self.roll(open_[i], points[:, j - 1])
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                number = np.where(self.keys[at] == h, self.numbers[at], 0 if j - i == 1 else -1) if len(self.keys) else np.full(n, 0 if j - i == 1 else -1)
                if j - i == 1 or (number >= 0).any():
                    found.append((i, number))
            yield j, found


def forward(pieces: Pieces, table: np.ndarray, points: np.ndarray, keep: bool = False):
    """log of the sum over all segmentations, per word and language. ``table``: piece by language; its last row is zero.

    With ``keep``, the scaled sums by position and the pieces by end as well."""
    n, languages = len(points), table.shape[1]
    alpha: dict[int, np.ndarray] = {0: np.ones((n, languages))}
    scale, ends = np.zeros(n), []
    for j, found in pieces.ends(points):
        now = np.zeros((n, languages))
        for i, number in found:
            now += alpha[i] * table[number]
        alpha[j] = now
        if keep:
            ends.append((j, found))
        elif j > pieces.longest:
            del alpha[j - pieces.longest - 1]
        if not keep and j % pieces.longest == 0:
            top = np.maximum(np.max([a.max(1) for a in alpha.values()], 0), 1e-300)
            alpha = {i: a / top[:, None] for i, a in alpha.items()}
            scale += np.log(top)
    total = np.log(np.maximum(alpha[points.shape[1]], 1e-300)) + scale[:, None]
    return (total, alpha, ends) if keep else total


def _flows(pieces: Pieces, table: np.ndarray, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(piece numbers, shares of all segmentations that have that piece in that place), per word and language."""
    total, alpha, ends = forward(pieces, table, points, keep=True)
    beta = {j: np.zeros_like(total) for j in range(points.shape[1])} | {points.shape[1]: np.ones_like(total)}
    whole = np.exp(total)
    for j, found in reversed(ends):
        for i, number in found:
            step = table[number] * beta[j]
            beta[i] += step
            yield number, alpha[i] * step / whole


def _log_flows(pieces: Pieces, table: np.ndarray, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for words so long that products would underflow: sums of logarithms."""
    with np.errstate(divide="ignore"):
        logs = np.log(table)
    n, width, none = len(points), points.shape[1], np.full((len(points), table.shape[1]), -np.inf)
    alpha, ends = {0: np.zeros_like(none)}, []
    for j, found in pieces.ends(points):
        alpha[j] = none
        for i, number in found:
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + logs[number])
        ends.append((j, found))
    beta = {j: none for j in range(width)} | {width: np.zeros_like(none)}
    for j, found in reversed(ends):
        for i, number in found:
            step = logs[number] + beta[j]
            beta[i] = np.logaddexp(beta[i], step)
            yield number, np.exp(alpha[i] + step - alpha[width])


def blocks(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code points) of the words of each length, in blocks of bounded size."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for n, at in sorted(by.items()):
        step = max(1, 200_000 // n)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield np.array(part), _points([words[i] for i in part])


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    table: np.ndarray
    _known: dict = field(default_factory=dict)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for at, points in blocks(words):
            out[at] = forward(self.pieces, self.table, points)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNDEFINED, 0.0)] * len(texts)
        counts = [Counter(_WORD.findall((t or "").lower())) for t in texts]
        new = list(set().union(*counts).difference(self._known))
        if len(self._known) + len(new) > REMEMBERED:
            self._known.clear()
            new = list(set().union(*counts))
        made = {w: row.tobytes() for w, row in zip(new, self.log_probabilities([START + w for w in new]))}
        long = {w: made.pop(w) for w in new if len(w) > SHORT}
        self._known.update(made)
        out = []
        for count in counts:
            if not count:
                out.append((UNDEFINED, 0.0))
                continue
            rows = np.frombuffer(b"".join([long[w] if len(w) > SHORT else self._known[w] for w in count])).reshape(len(count), -1)
            total = np.fromiter(count.values(), float, len(count)) @ rows
            odds = np.exp(total - total.max())
            best = int(np.argmax(odds))
            out.append((self.languages[best], float(odds[best] / odds.sum())))
        return out


def fit(pieces: Pieces, counts: dict[str, Counter], rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from its word counts."""
    languages = sorted(counts)
    words = sorted(set().union(*counts.values())) if counts else []
    weight = np.array([[counts[name][w] for name in languages] for w in words], float).reshape(len(words), len(languages))
    n = len(pieces.texts)
    table = np.zeros((n + 2, len(languages)))  # the unknown character, the pieces, and a row of zeros for no piece
    table[0], table[1 : n + 1] = UNKNOWN, 1 / max(1, n)
    marked = [START + w for w in words]
    for _ in range(rounds):
        expected = np.zeros((n + 2, len(languages)))
        for at, points in blocks(marked):
            flows = _flows if points.shape[1] <= SHORT else _log_flows
            for number, flow in flows(pieces, table, points):
                for k in range(len(languages)):
                    expected[:, k] += np.bincount(number % (n + 2), flow[:, k] * weight[at, k], n + 2)
        learnt = expected[1 : n + 1] + 0.01
        table[1 : n + 1] = learnt / learnt.sum(0)
    return Model(languages, pieces, table)


def train(docs: DataFrame, vocabulary: str, folds: int = 5, label_col: str = "lang") -> Model:
    """A model of ``label_col``, learnt from a bounded sample of the rows outside the held-out fold."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("__place")
    rows = docs.where(learnable(F.col("doc_id"), folds) & F.col(label_col).isNotNull() & (F.col(label_col) != UNDEFINED)).select(F.col(label_col).cast("string").alias("__lang"), place, "doc_id", "text")
    # The last place of each language's sample by ids alone; then texts up to it, of which repeated ids may leave too many.
    first = lambda rows, *more: rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__lang").orderBy("__place", *more))).where(F.col("__nth") <= MAX_SAMPLE)
    cuts = F.broadcast(first(rows.select("__lang", "__place")).groupBy("__lang").agg(F.max("__place").alias("__last")))  # a row a language
    sample = first(rows.join(cuts, "__lang").where("__place <= __last"), "doc_id", F.xxhash64("text")).select("__lang", "text")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            count: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                count.setdefault(lang, Counter()).update(w for w in _WORD.findall((text.as_py() or "").lower()) if len(w) <= FIT_LETTERS)
            rows = [(lang, w, n) for lang, c in count.items() for w, n in c.items()] + [(lang, None, 0) for lang in count]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    # the distinct words of the sample, of FIT_LETTERS letters at most
    counts: dict[str, Counter] = {}
    for r in sample.mapInArrow(work, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        counts.setdefault(r["lang"], Counter()).update({r["word"]: r["n"]} if r["word"] is not None else {})
    return fit(Pieces(read_pieces(vocabulary)), counts)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred and lang_score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = rows.withColumns({"lang_pred": F.lit("").cast("string"), "lang_score": F.lit(0.0)}).schema
    where = kept.index(text_col)

    def work(batches):
        import pyarrow as pa

        own = held.value
        claim("langid", own._known)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    cut = batch.slice(at, ROWS)
                    done = own.predict(cut.column(where).to_pylist())
                    yield pa.RecordBatch.from_arrays([*cut.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.float64())], names=[*cut.schema.names, "lang_pred", "lang_score"])
        finally:
            batch = cut = done = None
            forget("langid")

    return rows.mapInArrow(work, schema)


def language(docs: DataFrame, vocabulary: str, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row, by a model learnt outside the held-out fold."""
    done = score(docs.select("doc_id", "text"), train(docs, vocabulary, folds))
    return done.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
