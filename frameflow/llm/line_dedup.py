"""Line deduplication with DataFrame functions only.

1. Texts are split once: occurrences of lines travel as 128-bit hashes with their document and place, in a table that is
   written once. Where rows are repeated (found by their hashes), one of them is split.
2. Hashes are uniform, so fixed ranges of them are even; only a line with more than a share of all occurrences needs more
   room. A sample of the table finds such lines (a few for each partition at most) and their documents subdivide the
   range. So a line that stands in a third of all documents has as many parts as its count asks for.
3. Each range is sorted by hash, document and position, and streamed: the first occurrence in each document, and the
   number of documents, come from windows over the sorted rows. Only the lines that were subdivided meet again, as one
   partial sum a part.
4. What comes back to a document is a sparse bitmap of lines, never text.

Defined results: a null or empty text is one empty line; a key shorter than ``min_chars`` is always kept; rows that are
equal in doc_id and text are one document, and each of them gets the same bitmap; rows with one doc_id and different
texts are different documents; a null doc_id is a doc_id like any other; a very long text is one document of as many
lines as it has; an empty table gives an empty result; further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.llm.common import BLANKS, let, lower_ascii, materialise

DOC = ("__doc", "__text_hash")
SAMPLE = 256  # sampled occurrences for each partition
MADE = ("kept_text", "n_lines", "n_dropped")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """A row (h1, h2, document, pos) for each line with a key of at least ``min_chars`` code points."""
    keys = F.transform(lines_of(F.col(text_col)), line_key)
    return (
        docs.select(F.col(id_col).alias(DOC[0]), F.xxhash64(F.col(text_col)).alias(DOC[1]), F.posexplode(keys).alias("pos", "key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"), *DOC, "pos")
    )


def once(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and text columns of ``docs``, rows that are equal in both once; texts move only if they are repeated."""
    rows = docs.select(F.col(id_col).alias(DOC[0]), F.xxhash64(F.col(text_col)).alias(DOC[1]), F.col(text_col).alias("text"))
    again = materialise(rows.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(DOC[0]).alias("d"), F.col(DOC[1]).alias("h")), "again")
    named = lambda df: df.select(F.col(DOC[0]).alias(id_col), F.col("text").alias(text_col))
    if again.isEmpty():
        return named(rows)
    marked = rows.join(again, rows[DOC[0]].eqNullSafe(again["d"]) & (rows[DOC[1]] == again["h"]), "left")
    return named(marked.where("h is null")).unionByName(named(marked.where("h is not null").groupBy(*DOC).agg(F.first("text").alias("text"))))


def ranged(seen: DataFrame) -> DataFrame:
    """``seen`` by ranges of its hashes (range, sub), sorted by hash, document and position. ``sub`` is 0, or from 1 on
    for the documents that subdivide a line's range."""
    spark = seen.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = (16 * partitions - 1).bit_length()
    share = min(1.0, SAMPLE * partitions / max(1, seen.count()))
    sampled = seen.where(F.pmod(F.xxhash64(*DOC, "pos"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # a line with SAMPLE / 4 rows there has a quarter of a partition's share; so there are about 4 * partitions at most
    often = sampled.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAMPLE // 4)
    # a table, as rows made in the driver would start Python workers on the executors
    parts = materialise(often.select("h1", "h2", F.ceil(F.col("n") / (SAMPLE // 4)).alias("parts")), "often")
    sub = F.coalesce(1 + F.pmod(F.xxhash64(*DOC), F.col("parts")), F.lit(0))
    placed = seen.join(F.broadcast(parts), ["h1", "h2"], "left").select(F.shiftright("h1", 64 - bits).alias("range"), sub.alias("sub"), "h1", "h2", *DOC, "pos")
    return placed.repartition("range", "sub").sortWithinPartitions("range", "sub", "h1", "h2", *DOC, "pos")


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10, keep: str = "none") -> DataFrame:
    """Per document with lines to drop: ``bits``, the 64-line words that have any, as (word, mask) in order.

    A key found in at least ``min_docs`` documents loses all its lines (``keep='none'``) or all but the first by
    (document, position) (``keep='first'``). Words without a drop are left out, so an untouched document has no row.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    seen = materialise(occurrences(once(docs, id_col, text_col), id_col, text_col, min_chars), "lines")
    line = Window.partitionBy("range", "sub", "h1", "h2")
    in_doc = F.row_number().over(Window.partitionBy("range", "sub", "h1", "h2", *DOC).orderBy("pos"))
    place = F.struct(*DOC, "pos")
    streamed = ranged(seen).withColumn("opens", (in_doc == 1).cast("int"))
    streamed = streamed.withColumns({"n": F.sum("opens").over(line)} | ({"first": F.min(place).over(line)} if keep == "first" else {}))
    repeated = materialise(streamed.where((F.col("sub") > 0) | (F.col("n") >= min_docs)), "repeated")
    whole = {"n_all": F.sum("opens")} | ({"first_all": F.min("first")} if keep == "first" else {})
    # the subdivided lines only: about 4 * partitions rows at most
    sums = repeated.where("sub > 0").groupBy("h1", "h2").agg(*[v.alias(k) for k, v in whole.items()])
    dropped = repeated.join(F.broadcast(sums), ["h1", "h2"], "left").where(F.coalesce("n_all", "n") >= min_docs)
    if keep == "first":
        dropped = dropped.where(~place.eqNullSafe(F.coalesce("first_all", "first")))
    word = F.floor(F.col("pos") / 64).cast("int")
    bit = F.expr("shiftleft(1L, pos % 64)")
    return (
        dropped.groupBy(*DOC, word.alias("word")).agg(F.bit_or(bit).alias("mask"))
        .groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("bits"))
    )


def _kept(lines: Column, bits: Column) -> Column:
    """The lines whose bit is unset; ``bits`` is widened once so that each line is one array lookup."""
    none = F.array().cast("array<bigint>")
    dense = F.aggregate(F.coalesce(bits, F.array().cast("array<struct<word:int,mask:bigint>>")), none, lambda acc, b: F.concat(acc, F.array_repeat(F.lit(0).cast("bigint"), b["word"] - F.size(acc)), F.array(b["mask"])))
    return let(
        F.struct(lines.alias("lines"), dense.alias("dense")),
        lambda s: F.filter(s["lines"], lambda _, i: F.coalesce(F.get(s["dense"], (i / 64).cast("int")), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i % 64)) == 0),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10, keep: str = "none") -> DataFrame:
    """``docs`` with ``kept_text`` (the lines that stay, joined by newline), ``n_lines`` and ``n_dropped``."""
    bitmaps = drop_bitmaps(docs, id_col, text_col, min_chars, min_docs, keep).withColumnsRenamed({DOC[0]: "d", DOC[1]: "h"})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in MADE])  # one column, so that no name meets another
    rows = docs.select(row.alias("row"), F.col(id_col).alias(DOC[0]), F.xxhash64(F.col(text_col)).alias(DOC[1]), F.col(text_col).alias("text"))
    joined = rows.join(bitmaps, rows[DOC[0]].eqNullSafe(bitmaps["d"]) & (rows[DOC[1]] == bitmaps["h"]), "left")
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("bits").isNull(), lines).otherwise(_kept(lines, F.col("bits")))
    made = let(
        F.struct(lines.alias("lines"), kept.alias("kept")),
        lambda s: F.struct(F.size(s["lines"]).cast("bigint").alias("n_lines"), (F.size(s["lines"]) - F.size(s["kept"])).cast("bigint").alias("n_dropped"), F.array_join(s["kept"], "\n").alias("kept_text")),
    )
    return joined.select("row", made.alias("made")).select("row.*", "made.*")
