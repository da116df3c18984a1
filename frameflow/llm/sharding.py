"""Sharding by sampled splitters with DataFrame functions only: shards of nearly equal bytes, in key order.

1. A narrow table (id, size, checksum, tie) is written once; texts are read once and never shuffled.
2. Keys are sampled with a probability in proportion to their size; quantiles of the sample split the keys into ranges.
3. Ranges that turn out overfull are subdivided: by key, or by the tie hash where one key fills the range alone.
4. The ranges' exact sums (a table of ``ranges`` rows, whatever the input) give each range the bytes and rows before it;
   a running sum inside a range places each row, and a shard ends where its share of all bytes ends.

So shard sizes differ from an equal share by less than the largest record. Defined results: a null text has no bytes
(size 1) and a null checksum's stead is that of the empty text; null ids come first; equal rows each get a slot of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.llm.common import materialise

SAMPLES_PER_RANGE = 32
RANGE_BYTES = 64 << 20
MIN_RANGES, MAX_RANGES = 256, 65_536


def _place(bounds: list[int], key: Column) -> Column:
    """How many of the sorted ``bounds`` are <= key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = F.array(*map(F.lit, bounds))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(table, lo + s - 1) <= key), lo + s).otherwise(lo))


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard (0 to n_shards - 1) and slot (gapless from 0 within the shard)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text, F.monotonically_increasing_id()).alias("tie"))
    rows = materialise(rows, "sized")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(MIN_RANGES, min(MAX_RANGES, -(-total // range_bytes)))
    share = max(1, -(-total // ranges))
    uniform = (F.xxhash64(F.lit("sample"), F.col("id"), F.col("tie")).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52))
    sampled = rows.where(F.col("id").isNotNull() & (uniform < F.col("size") * (ranges * SAMPLES_PER_RANGE / max(1, total))))
    # exact over a sample of bounded size: ranges * SAMPLES_PER_RANGE keys on average
    bounds = sampled.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], ranges * 4)).first()[0] or []
    bounds = sorted(set(bounds))
    ranged = rows.withColumn("range", F.when(F.col("id").isNull(), -1).otherwise(_place(bounds, F.col("id"))))
    full = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.min("id").alias("lo"), F.max("id").alias("hi")).where(F.col("b") > 2 * share).collect()
    parts = ranged.sparkSession.createDataFrame([(r["range"], r["lo"], r["hi"], -(-r["b"] // share)) for r in full], "range int, lo bigint, hi bigint, parts bigint")
    by_key = F.floor((F.col("id") - F.col("lo")).cast("double") * F.col("parts") / (F.col("hi") - F.col("lo") + 1).cast("double"))
    sub = F.when(F.col("parts").isNull(), 0).when(F.col("hi") > F.col("lo"), by_key).otherwise(F.pmod("tie", F.col("parts")))
    cut = ranged.join(F.broadcast(parts), "range", "left").withColumn("sub", sub.cast("bigint")).drop("lo", "hi", "parts")
    # at most ranges + 1 + the sum of parts, below 3 * ranges rows
    sums = cut.groupBy("range", "sub").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    starts, b, k = [], 0, 0
    for r in sorted(sums, key=lambda r: (r["range"], r["sub"])):
        starts.append((r["range"], r["sub"], b, k))
        b, k = b + r["b"], k + r["n"]
    starts = cut.sparkSession.createDataFrame(starts, "range int, sub bigint, bytes_before bigint, rows_before bigint")
    w = Window.partitionBy("range", "sub").orderBy("id", "tie", "crc")
    before = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("bytes_before")
    placed = cut.join(F.broadcast(starts), ["range", "sub"]).select(
        "id", "size", "crc", F.least(F.floor(before * n_shards / F.lit(max(1, total))), F.lit(n_shards - 1)).cast("int").alias("shard"), (F.row_number().over(w) - 1 + F.col("rows_before")).alias("rank")
    )
    placed = materialise(placed, "placed")
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))  # n_shards rows
    return placed.join(firsts, "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - F.col("first")).alias("slot"))
