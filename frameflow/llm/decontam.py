"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows are few and proven so (``max_windows``, ``max_bytes``): they become a hash set inside the scan's
projection, which Spark broadcasts with the stage. A
document looks up the hash of every three consecutive words in the set of the windows' first words, and only where that
hits compares the whole window with the set of windows. So documents are scanned once, nothing but hits leaves a row,
and the one shuffle carries a narrow row a document. A larger benchmark goes through a shuffled join of window hashes.

Defined results: a null text has no words; an item without words, or with a null item_id, has no windows; a very long
text is scanned whole in its row; repeated rows each get a row of their own; empty tables give empty results or no hits;
columns of the same names in the inputs don't meet; extra columns are ignored, or pass through ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import let, lower_ascii, numbered

WINDOW = 13
MAX_WINDOWS = 100_000
MAX_BYTES = 32 << 20  # of windows and their items' ids
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same in a text as it is


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows: window, len, lead (hash of its first up to three words), items (ids as strings)."""
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("len", F.least(F.size("words"), F.lit(size)))
    each = rows.select("item", "len", F.explode(F.expr("transform(sequence(0, size(words) - len), i -> slice(words, i + 1, len))")).alias("w"))
    return (
        each.groupBy(F.array_join("w", " ").alias("window"))
        .agg(F.first("len").alias("len"), F.first(_lead("w")).alias("lead"), F.collect_set("item").alias("items"))
    )


def _lead(w: str) -> Column:
    return F.expr(f"case size({w}) when 1 then xxhash64({w}[0]) when 2 then xxhash64({w}[0], {w}[1]) else xxhash64({w}[0], {w}[1], {w}[2]) end")


def _hits(words: Column, windows: list) -> Column:
    """All occurrences of the windows in ``words``: an array of (p, e, w), words p to e - 1 being window w."""
    found = []
    for lead in sorted({min(3, r["len"]) for r in windows}):
        leads = sorted({r["lead"] for r in windows if min(3, r["len"]) == lead})
        starts = _starts(words, lead, leads)
        for n in sorted({r["len"] for r in windows if min(3, r["len"]) == lead}):
            found.append(_spans(words, starts, n, sorted({r["window"] for r in windows if r["len"] == n})))
    return F.array_sort(F.concat(*found))


def _starts(words: Column, lead: int, leads: list[int]) -> Column:
    """Positions whose first ``lead`` words hash into ``leads``."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - lead, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(lead)]).isin(leads))


def _spans(words: Column, starts: Column, n: int, texts: list[str]) -> Column:
    """The spans of ``n`` words from ``starts`` whose text is one of ``texts``."""
    spans = F.transform(starts, lambda p: F.struct(p.alias("p"), (p + n).alias("e"), F.array_join(F.slice(words, p + 1, n), " ").alias("w")))
    return F.filter(spans, lambda s: (s["e"] <= F.size(words)) & s["w"].isin(texts))


def _covered(hits: Column) -> Column:
    """How many words lie in any of the spans, which are sorted by start."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(hits, zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["p"], a["end"]))).alias("n"), F.greatest(a["end"], s["e"]).alias("end")), lambda a: a["n"].cast("bigint"))


NO_SPANS = "array<struct<p:int,e:int,w:string>>"


def _scan_in_row(rows: DataFrame, windows: DataFrame) -> DataFrame:
    known = windows.select("window", "len", "lead").collect()
    found = (lambda words: _hits(words, known)) if known else lambda words: F.array().cast(NO_SPANS)
    return rows.select("row", "text", let(words_of(F.col("text")), lambda words: F.struct(F.size(words).cast("bigint").alias("n_words"), found(words).alias("hits"))).alias("scan"))


def _scan_by_join(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """For benchmarks beyond the bound: windows of every document meet the benchmark's in a shuffled join."""
    rows = numbered(rows, "number")
    lengths = [r[0] for r in windows.select("len").distinct().collect()]  # at most WINDOW values
    words = rows.select("number", words_of(F.col("text")).alias("words"))
    each = [F.when(F.size("words") >= n, F.expr(f"transform(sequence(0, size(words) - {n}), i -> struct(i as p, i + {n} as e, array_join(slice(words, i + 1, {n}), ' ') as w))")).otherwise(F.array().cast(NO_SPANS)) for n in lengths]
    spans = words.select("number", F.explode(F.concat(*each)).alias("s"))
    met = spans.join(windows.select("window"), F.col("s.w") == F.col("window"), "left_semi").groupBy("number").agg(F.array_sort(F.collect_list("s")).alias("hits"))
    scan = F.struct(F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"), F.coalesce("hits", F.array().cast(NO_SPANS)).alias("hits"))
    return rows.join(met, "number", "left").select("row", "text", scan.alias("scan"))


def _scan(docs: DataFrame, windows: DataFrame, text_col: str, max_windows: int, max_bytes: int) -> tuple[DataFrame, bool]:
    """row (a struct of all columns, so that no name meets another), text and scan (n_words, hits); whether the windows
    are within the bounds."""
    n, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window") + F.octet_length(F.array_join("items", ","))), F.lit(0))).first()
    few = n <= max_windows and size <= max_bytes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return (_scan_in_row if few else _scan_by_join)(rows, windows), few


def _judged(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = WINDOW, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, spans (hit word ranges), items (sorted ids, as strings) and
    contaminated: the hit words are at least a twentieth of all words."""
    windows = benchmark_windows(benchmark, item_col, "text", size)
    scanned, few = _scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), windows, "text", max_windows, max_bytes)
    rows = scanned.select(F.monotonically_increasing_id().alias("__row"), F.col("row.id").alias("__id"), F.col("scan.n_words").alias("n_words"), F.col("scan.hits").alias("hits"))
    each = rows.select("__row", "__id", "n_words", _covered(F.col("hits")).alias("n_hit"), F.transform("hits", lambda h: F.struct(h["p"], h["e"])).alias("spans"), F.explode_outer(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("window"))
    items = windows.select("window", "items")
    met = each.join(F.broadcast(items) if few else items, "window", "left")
    out = met.groupBy("__row").agg(
        F.first("__id").alias(id_col), F.first("n_words").alias("n_words"), F.first("n_hit").alias("n_hit"), F.first("spans").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return out.drop("__row").withColumn("contaminated", _judged(F.col("n_hit"), F.col("n_words")))


def _without(text: Column, hits: Column) -> Column:
    """``text`` without the characters from each span's first word to its last; all others stay as they are."""
    raw, gaps = F.split(text, GAPS, -1), F.regexp_extract_all(text, F.lit(GAPS), F.lit(0))
    lead = F.when(F.element_at(raw, 1) == "", 1).otherwise(0)  # an empty string before a leading gap

    def stays(s: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            word = F.when(F.exists(s["hits"], lambda h: (h["p"] <= i - s["lead"]) & (i - s["lead"] < h["e"])), "").otherwise(x)
            gap = F.when(F.exists(s["hits"], lambda h: (h["p"] <= i - s["lead"]) & (i - s["lead"] + 1 < h["e"])), "").otherwise(F.coalesce(F.get(s["gaps"], i), F.lit("")))
            return F.concat(word, gap)

        return F.array_join(F.transform(s["raw"], part), "")

    return let(F.struct(raw.alias("raw"), gaps.alias("gaps"), lead.alias("lead"), hits.alias("hits")), stays)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", size: int = WINDOW, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove='spans'``) with hit spans cut out of the texts, from the first
    letter of a span to its last. Without a shuffle while the benchmark is within the bounds."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    scanned, _ = _scan(docs, benchmark_windows(benchmark, item_col, "text", size), text_col, max_windows, max_bytes)
    hits = F.col("scan.hits")
    if remove == "documents":
        judged = let(F.col("scan"), lambda s: _judged(_covered(s["hits"]), s["n_words"]))
        return scanned.where(~judged).select("row.*")
    cut = F.when(F.size(hits) > 0, _without(F.col("text"), hits)).otherwise(F.col("text"))
    return scanned.select(*[cut.alias(c) if c.lower() == text_col.lower() else F.col(f"row.`{c}`") for c in docs.columns])
