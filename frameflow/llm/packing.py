"""Harmonic packing of documents into sequences of a fixed capacity.

Class k holds pieces with lengths just under capacity / k, and each of its sequences takes exactly k of them. A document
is cut into the longest admissible pieces: lengths s of which floor(capacity / s) leave at most ``slack`` of a sequence.
Every worker fills the bins of its classes on its own, in one pass over its rows and without a shuffle. Bins that are
still open when a worker's rows end are emptied in turn into full sequences; the last few tokens go to sequences with
lengths that are powers of two, which need no padding. So at most ``slack`` of any sequence is padding.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; an empty table gives no rows;
null ids are kept; extra columns are ignored. Memory: one batch of texts, and an open bin for each class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from frameflow.llm.wordcode import encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
ROWS = 128
REMEMBERED = 18 << 20  # bytes of texts' parts, twice at most, that a worker keeps


class HarmonicBins:
    """The open bins of one worker. ``add`` and ``close`` give finished sequences: lists of (doc, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, slack: float = 0.01):
        self.capacity = capacity
        self.largest, last = [0] * (capacity + 1), 0  # by length, the longest admissible piece in it
        for s in range(1, capacity + 1):
            if capacity % s <= slack * capacity:
                last = s
            self.largest[s] = last
        self.open: dict[int, list] = {}

    def add(self, doc: int | None, ids: bytes) -> Iterator[list]:
        n, at = len(ids) // 4, 0
        while at < n:
            size = self.largest[min(self.capacity, n - at)]
            k = self.capacity // size
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, at, ids[4 * at : 4 * (at + size)], n))
            at += size
            if len(bin_) == k:
                del self.open[k]
                yield bin_

    def close(self) -> Iterator[list]:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(len(p[2]) // 4 for p in rest)
        self.open = {}
        room, bin_ = self._room(left), []
        for doc, start, ids, n in rest:
            at, size = 0, len(ids) // 4
            while at < size:
                take = min(room, size - at)
                bin_.append((doc, start + at, ids[4 * at : 4 * (at + take)], n))
                at, room, left = at + take, room - take, left - take
                if not room:
                    yield bin_
                    room, bin_ = self._room(left), []

    def _room(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << (max(1, left).bit_length() - 1)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, slack: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: its document's id, where it starts there, its length and ids, and its place (sequence, offset).

    sequence_id is unique over all workers: the worker's partition times 2^33 and a running number."""
    end = end_id.to_bytes(4, "little")

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ctx = TaskContext.get()
        code, bins, number = encoder(tokenizer, REMEMBERED), HarmonicBins(capacity, slack), (ctx.partitionId() if ctx else 0) << 33

        def table(sequences: list[list]):
            nonlocal number
            out: list[list] = [[] for _ in range(7)]
            for pieces in sequences:
                offset = 0
                for doc, start, ids, n in pieces:
                    for column, v in zip(out, (doc, start, len(ids) // 4, ids, n, number, offset), strict=True):
                        column.append(v)
                    offset += len(ids) // 4
                number += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                coded = code.encode(part.column(1).to_pylist())
                yield table([s for doc, ids in zip(part.column(0).to_pylist(), coded, strict=True) for s in bins.add(doc, ids + end)])
        yield table(list(bins.close()))

    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, SCHEMA)


def padding(lengths: np.ndarray, capacity: int = 4096) -> int:
    """Padding tokens of sequences of these lengths: none at a power of two, up to the capacity elsewhere."""
    whole = (lengths & (lengths - 1)) == 0
    return int((capacity - lengths[~whole]).sum())
