"""Token counts of whole texts, without their ids: pieces are counted once for each distinct pre-token.

A pre-token is a text's part between two places where the vocabulary always splits: where white space follows something
else (see ``wordcode``). Three steps:

1. All texts' distinct pre-tokens with their frequencies: each task sums up its own first. The library encodes each
   distinct one once, and only the number of its pieces is kept.
2. Each document's pre-token frequencies are met with these numbers. The most frequent pre-tokens, ``HEAD`` at most and
   of at most ``LONGEST`` bytes each, go to all tasks, which sum them up while they count a document's pre-tokens. So no
   hot pre-token is ever a join's key.
3. What a document has besides (rare pre-tokens, with their frequencies) is joined by pre-token and summed by document.

Pre-tokens of more than ``LONGEST`` bytes, and texts that go to the library whole (with an added token's string, U+0000,
or combining marks under a lower-casing vocabulary), are counted where they stand. Nothing is truncated or padded.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and null ids get rows of their own; an
empty table gives an empty result; very long texts are counted whole, one at a time; extra columns are ignored. Memory of
a task: the head, ``FLUSH`` bytes of pre-tokens, and a slice of texts.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import materialise
from frameflow.llm.wordcode import ENTRY, LONGEST, encoder

HEAD = 1 << 17
FLUSH = 24 << 20  # bytes of pre-tokens and counters that a task sums up before it passes them on
ROWS = 64
STEPS = 4  # frequency steps an octave in which the head's cut is looked for


def _distinct(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(part, n): the pre-tokens of all texts and how often they stand there."""

    def work(batches):
        import pyarrow as pa

        code, seen, held = encoder(tokenizer), Counter(), 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["part", "n"])

        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                parts = code.keys_of(text, text.encode("utf-8", "surrogatepass")) if text else None
                for part, n in Counter(parts or ()).items():
                    if part in seen:
                        seen[part] += n
                    elif len(part) <= LONGEST:
                        seen[part] = n
                        held += len(part) + ENTRY
                if held > FLUSH:
                    yield out()
                    seen, held = Counter(), 0
        yield out()

    return texts.select("text").mapInArrow(work, "part binary, n bigint").groupBy("part").agg(F.sum("n").alias("n"))


def _pieces(distinct: DataFrame, tokenizer: str) -> DataFrame:
    """(part, n, pieces): each distinct pre-token is encoded once, and remembered by nobody."""

    def work(batches):
        import pyarrow as pa

        code = encoder(tokenizer)
        for batch in batches:
            made = [len(code.ids(p)) // 4 for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=["part", "n", "pieces"])

    return distinct.mapInArrow(work, "part binary, n bigint, pieces bigint")


def _cut(pieces: DataFrame, head: int) -> int:
    """The least frequency of the head: the lowest step at which no more than ``head`` pre-tokens are left."""
    step = F.floor(F.log2("n") * STEPS)
    steps, left, cut = pieces.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).orderBy(F.desc("step")).collect(), head, 1 << 62  # 63 octaves at most
    for r in steps:
        left -= r["k"]
        if left < 0:
            break
        cut = r["n"]
    return cut


def _documents(rows: DataFrame, tokenizer: str, known) -> DataFrame:
    """A row for each document: number (its own), id, bytes, tokens of the head, and the other pre-tokens with their frequencies."""
    kind = rows.schema["id"].dataType

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ctx, code, head = TaskContext.get(), encoder(tokenizer), known.value
        number = (ctx.partitionId() if ctx else 0) << 33
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                cut = batch.slice(k, ROWS)
                sizes, tokens, rare, often = [], [], [], []
                for value in cut.column(1):
                    text = value.as_py() or ""
                    data, total, parts, ns = text.encode("utf-8", "surrogatepass"), 0, [], []
                    keys = code.keys_of(text, data) if text else ()
                    if keys is None:
                        keys, total = (), len(code.whole(text)) // 4
                    for part, n in Counter(keys).items():
                        made = head.get(part)
                        if made is not None:
                            total += n * made
                        elif len(part) > LONGEST:
                            total += n * (len(code.ids(part)) // 4)
                        else:
                            parts.append(part)
                            ns.append(n)
                    sizes.append(len(data))
                    tokens.append(total)
                    rare.append(parts)
                    often.append(ns)
                numbers = pa.array(range(number, number + cut.num_rows), pa.int64())
                number += cut.num_rows
                yield pa.RecordBatch.from_arrays([numbers, cut.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(rare, pa.list_(pa.binary())), pa.array(often, pa.list_(pa.int64()))], names=["number", "id", "n_bytes", "n", "parts", "ns"])

    return rows.mapInArrow(work, f"number bigint, id {kind.simpleString()}, n_bytes bigint, n bigint, parts array<binary>, ns array<bigint>")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Per row of ``docs``: its id as doc_id, n_bytes (UTF-8), n_tokens, and whether those are more than ``limit``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = materialise(_pieces(_distinct(rows, tokenizer), tokenizer), "pieces")
    cut = _cut(pieces, head)
    # head pre-tokens of LONGEST bytes at most
    most = pieces.where(F.col("n") >= cut).select("part", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(most.column(0).to_pylist(), most.column(1).to_pylist(), strict=True)))
    each = materialise(_documents(rows, tokenizer, known), "frequencies")
    rare = each.where(F.size("parts") > 0).select("number", F.explode(F.arrays_zip("parts", "ns")).alias("p")).select("number", F.col("p.parts").alias("part"), F.col("p.ns").alias("times"))
    met = rare.join(pieces.where(F.col("n") < cut).select("part", "pieces"), "part").select("number", F.lit(None).cast(each.schema["id"].dataType).alias("id"), F.lit(None).cast("bigint").alias("n_bytes"), (F.col("times") * F.col("pieces")).alias("n"))
    done = each.select("number", "id", "n_bytes", "n").unionByName(met).groupBy("number").agg(F.max("id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
