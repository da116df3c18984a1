"""Exact top-k inner-product search by MaxScore, over shards of vectors.

A query's terms are its components. A block of candidates bounds each term's contribution by the block's extremes of
that component. The terms with the smallest bounds, as long as those sum to less than the query's k-th best score so
far, are non-essential: no candidate gets into the result by them alone. The essential terms are traversed for the whole
block; candidates that stay competitive with the rest of the bound are probed in the other terms, a few at a time, and
leave as soon as they fall behind. Each task keeps a query's best k over all its blocks, and the tasks' results merge.

The query set is stated by the caller. Up to ``QUERY_BYTES`` of it are broadcast. A larger one is dealt into blocks of
that size and the candidates into as many slices as the table has of ``SLICE_BYTES``; each (block, slice) is a place where
a copy of either meets, queries first, candidates streamed after them, so a task holds one block of queries and one batch
of rows. Nothing but a bounded set of queries goes through the driver.
Defined results: vectors that are null or hold a null or non-finite component take no part; rows with the query's own id
aren't its candidates; shorter vectors count as ending in zeros; ties go to the smaller id; of several queries with one
id the smallest vector counts; repeated candidate rows are candidates each. Scores are exact below 2^63.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BYTES = 16 << 20
SLICE_BYTES = 256 << 20
MAX_TASKS = 1 << 16  # a task may take several places, one after another
BLOCK = 16_384
PROBE = 8


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, as integers; null where the vector takes no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(wide, lambda x: F.floor(x * factor).cast("bigint")))


class Best:
    """The best k (score, id) of one query so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Block:
    """Candidates with the extremes of each component. Products are exact: floats while 2^53 holds them, else integers."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, query_most: int):
        most = int(np.abs(rows).max(initial=0))
        kind = np.float64 if most * max(1, query_most) * max(1, rows.shape[1]) < 1 << 53 else np.int64
        self.ids, self.kind = ids, kind
        self.columns = np.asfortranarray(rows.astype(kind))
        self.high, self.low = self.columns.max(0), self.columns.min(0)

    def search(self, own: int, query: np.ndarray, best: Best) -> None:
        q = query.astype(self.kind)
        terms = np.flatnonzero(q)
        bounds = np.maximum(q[terms] * self.high[terms], q[terms] * self.low[terms])
        order = np.argsort(-bounds, kind="stable")
        terms, bounds = terms[order], bounds[order]
        after = np.concatenate([np.cumsum(bounds[::-1])[::-1], np.zeros(1, self.kind)])  # bound of the terms from i on
        left = np.flatnonzero(self.ids != own)
        if best.least is None:  # the first candidates set a score to beat
            first, left = left[: 64 * best.k], left[64 * best.k :]
            best.add((self.columns[np.ix_(first, terms)] @ q[terms]).astype(np.int64), self.ids[first])
            if best.least is None or not len(left):
                return
        essential = int(np.argmax(after < best.least)) if (after < best.least).any() else len(terms)
        score = self.columns[:, terms[:essential]] @ q[terms[:essential]] if len(left) == len(self.ids) else self.columns[np.ix_(left, terms[:essential])] @ q[terms[:essential]]
        for at in range(essential, len(terms) + PROBE, PROBE):
            at = min(at, len(terms))
            stay = score + after[at] >= best.least
            left, score = left[stay], score[stay]
            if at == len(terms) or not len(left):
                break
            probed = terms[at : at + PROBE]
            score = score + self.columns[np.ix_(left, probed)] @ q[probed]
        if len(left):
            best.add(score.astype(np.int64), self.ids[left])


def _matrix(lists, dims: int) -> np.ndarray:
    """A list array of integers as rows of ``dims``; shorter lists end in zeros, components past ``dims`` meet none."""
    ends = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ends), dims), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(ends)), ends)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)
        inside = col < dims
        out[row[inside], col[inside]] = flat[inside]
    return out


class Search:
    """The best k of a block of queries (ids, rows of a matrix) over all candidates that it is given."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, k: int):
        self.names, self.vectors, self.best = names, vectors, [Best(k) for _ in names]
        self.most = int(np.abs(vectors).max(initial=0))

    def add(self, ids, lists) -> None:
        for at in range(0, len(ids), BLOCK):
            block = Block(ids.slice(at, BLOCK).to_numpy(zero_copy_only=False), _matrix(lists.slice(at, BLOCK), self.vectors.shape[1]), self.most)
            for own, q, b in zip(self.names.tolist(), self.vectors, self.best, strict=True):
                block.search(own, q, b)

    def result(self):
        import pyarrow as pa

        cols = [np.repeat(self.names, [len(b.ids) for b in self.best])] + [np.concatenate([getattr(b, x) for b in self.best] or [np.zeros(0, np.int64)]) for x in ("ids", "scores")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "id", "score"])


FOUND = "query_id bigint, id bigint, score bigint"


def _by_broadcast(asked: DataFrame, rows: DataFrame, k: int, dims: int) -> DataFrame:
    """``asked`` is at most ``QUERY_BYTES``: it goes to all tasks, and candidates stay where they are."""
    got = sorted((r["id"], r["v"]) for r in asked.collect())
    table = np.zeros((len(got), dims), np.int64)
    for row, (_, v) in zip(table, got, strict=True):
        row[: len(v)] = v
    held = rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in got], np.int64), table))

    def work(batches):
        search = Search(*held.value, k)
        for batch in batches:
            search.add(batch.column(0), batch.column(1))
        yield search.result()

    return rows.mapInArrow(work, FOUND)


def _by_places(asked: DataFrame, rows: DataFrame, k: int, n: int, dims: int) -> DataFrame:
    """A copy of each query for every slice of candidates and of each candidate for every block of queries."""
    blocks = -(-n * max(1, dims) * 8 // QUERY_BYTES)
    size = rows.agg(F.coalesce(F.sum(F.size("v") * 8 + 8), F.lit(0))).first()[0]
    slices = max(1, -(-size // SLICE_BYTES))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
    copies = asked.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"), every(slices).alias("s"), F.lit(0).alias("part"), "id", "v")
    dealt = rows.select("id", "v", F.pmod(F.monotonically_increasing_id(), F.lit(slices)).alias("s")).select(every(blocks).alias("b"), "s", F.lit(1).alias("part"), "id", "v")
    placed = copies.unionByName(dealt).select((F.col("b") * slices + F.col("s")).alias("place"), "part", "id", "v")

    def work(batches):
        import pyarrow as pa

        place, names, lists, search = None, [], [], None
        for batch in batches:
            places, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(parts) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(places)], strict=True):
                if a == b:
                    continue
                if places[a] != place:
                    if search:
                        yield search.result()
                    place, names, lists, search = places[a], [], [], None
                ids, vectors = batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a)
                if not parts[a]:
                    names.append(ids.to_numpy(zero_copy_only=False))
                    lists.append(_matrix(vectors, dims))
                elif names or search:
                    if search is None:
                        search, names, lists = Search(np.concatenate(names), np.concatenate(lists), k), [], []
                    search.add(ids, vectors)
        yield search.result() if search else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["query_id", "id", "score"])

    return placed.repartition(min(blocks * slices, MAX_TASKS), "place").sortWithinPartitions("place", "part").mapInArrow(work, FOUND)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """query_id, rank (from 1), the candidate's id and score, for each query's k best candidates (fewer if there are)."""
    rows = candidates.select(F.col(id_col).cast("bigint").alias("id"), scaled(F.col(vector_col), factor).alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col(id_col).cast("bigint").alias("id"), scaled(F.col(vector_col), factor).alias("v")).where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    n, dims = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    found = _by_broadcast(asked, rows, k, dims) if n * max(1, dims) * 8 <= QUERY_BYTES else _by_places(asked, rows, k, n, dims)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
