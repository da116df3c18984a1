"""Token ids as directly addressable codes (DAC), in segments that Spark writes and reads.

A segment splits its ids into levels of 8-bit chunks, lowest first. A continuation bitmap says which ids go on in the
next level, and a rank directory (ones before each 512 bits) finds where. So id i is read in a step a level, without
decoding a block. Documents stand in ascending id order: the writer range-partitions them by id, each task writes the
segments of its range, and a table row carries a segment, its documents and its place in the range. Parquet is only the
container: its commit protocol drops the output of lost tasks, and it goes to any store that Spark reaches. Segments stand
in it plain and uncompressed, so ``segment_places`` finds their bytes in a file, and a token is read by seeking to them.

Defined results: a null or empty text is its end id alone; null ids come first; repeated rows are documents of their
own; an empty table writes no segments; extra columns are ignored. Memory: one segment, or one document if larger; a
very long text is one document of one segment.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.llm.common import new_path
from frameflow.llm.wordcode import encoder

MAGIC = b"DAC1"
BLOCK = 512
SEGMENT_TOKENS = 1 << 18
ROWS = 128


def dac_encode(ids: np.ndarray) -> bytes:
    """A segment's bytes: magic, number of levels, and for each level its count, chunks, bitmap and rank directory."""
    rest, levels = np.ascontiguousarray(ids, "<u4"), []
    while True:
        more = rest > 0xFF
        last = not more.any()
        parts = [struct.pack("<QB", len(rest), not last), (rest & 0xFF).astype(np.uint8).tobytes()]
        if not last:
            bits = np.zeros(-(-len(more) // BLOCK) * BLOCK, bool)
            bits[: len(more)] = more
            ones = bits.reshape(-1, BLOCK).sum(1)
            parts += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
        levels.append(b"".join(parts))
        if last:
            return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)
        rest = rest[more] >> 8


class DacSegment:
    """Random access to the ids of a segment: ``segment[i]`` and ``segment.slice(a, b)``; both touch only what they need,
    so ``data`` may be a view of a mapped file."""

    def __init__(self, data):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        self.levels, at = [], 5
        for _ in range(data[4]):
            n, more = struct.unpack_from("<QB", data, at)
            at += 9
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bitmap = ranks = None
            if more:
                blocks = -(-n // BLOCK)
                bitmap = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
                at += blocks * BLOCK // 8
                ranks = np.frombuffer(data, "<u4", blocks, at)
                at += 4 * blocks
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit ``i``."""
        if i // BLOCK >= len(ranks):
            block = len(ranks) - 1
            return int(ranks[block]) + int(np.bitwise_count(bitmap[block * BLOCK // 8 :]).sum()) if len(ranks) else 0
        first = i // BLOCK * BLOCK
        whole = int(np.bitwise_count(bitmap[first // 8 : i // 8]).sum())
        part = int(bitmap[i // 8]) & ((1 << (i % 8)) - 1)
        return int(ranks[i // BLOCK]) + whole + part.bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if bitmap is None or not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(bitmap, ranks, i)
        return value

    def slice(self, a: int, b: int, level: int = 0) -> np.ndarray:
        chunks, bitmap, ranks = self.levels[level]
        out = chunks[a:b].astype("<u4")
        if bitmap is not None and b > a:
            bits = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            first = self._rank(bitmap, ranks, a)
            out[bits] |= self.slice(first, first + int(bits.sum()), level + 1) << 8
        return out


SEGMENTS = "shard bigint, shard_start bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, dac binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every whole text, append ``end_id`` and write segments in ascending id order to ``path``."""
    end = end_id.to_bytes(4, "little")

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ctx = TaskContext.get()
        code, shard, start = encoder(tokenizer), ctx.partitionId() if ctx else 0, 0
        names, lengths, parts, held = [], [], [], 0
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())

        def segment():
            row = (shard, start, held, names, lengths, dac_encode(np.frombuffer(b"".join(parts), "<u4")))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["shard", "shard_start", "n_tokens", "doc_ids", "lengths", "dac"])

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                cut = batch.slice(i, ROWS)
                for doc, ids in zip(cut.column(0).to_pylist(), code.encode(cut.column(1).to_pylist()), strict=True):
                    parts.append(ids + end)
                    names.append(doc)
                    lengths.append(len(ids) // 4 + 1)
                    held += lengths[-1]
                    if held >= segment_tokens:
                        yield segment()
                        start += held
                        names, lengths, parts, held = [], [], [], 0
        if names:
            yield segment()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    coded = rows.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(work, SEGMENTS)
    coded.write.options(**{"compression": "none", "parquet.enable.dictionary": "false"}).parquet(path)


def segment_places(data) -> list[tuple[int, int]]:
    """(offset, length) of each segment in a part file, given as bytes or a mapped file: found once, then read by seeking.

    A plain cell is its length (4 bytes, little-endian) and its bytes; the footer says where the column's chunks lie."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    out, groups = [], pq.ParquetFile(pa.BufferReader(pa.py_buffer(data))).metadata
    for g in range(groups.num_row_groups):
        chunk = next(c for c in map(groups.row_group(g).column, range(groups.num_columns)) if c.path_in_schema == "dac")
        at, end = chunk.data_page_offset, chunk.data_page_offset + chunk.total_compressed_size
        while (at := data.find(MAGIC, at, end)) >= 0:
            n = int.from_bytes(data[at - 4 : at], "little")
            out.append((at, n))
            at += n
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, unsigned 32-bit)."""
    segments = spark.read.parquet(path)
    # one row for each range of the writer: bounded by its number of partitions
    sums, before, rows = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect(), 0, []
    for r in sums:
        rows.append((r["shard"], before))
        before += r["n"]
    bases = spark.createDataFrame(rows, "shard bigint, base bigint")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for start, names, lengths, data in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                segment, at, ids = DacSegment(data), 0, []
                for n in lengths:
                    ids.append(segment.slice(at, at + n).tobytes())
                    at += n
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    placed = segments.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("shard_start")).alias("start"), "doc_ids", "lengths", "dac")
    return placed.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to the shared folder and read the documents back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path)
