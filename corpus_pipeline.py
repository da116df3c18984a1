"""From documents to packed sequences: language ID, line dedup, near-dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents. Further columns of documents pass through; nulls, empty texts, repeated
rows and empty tables follow the operators' docstrings. No stage goes by doc_id: rows that share one, or have none, are
documents of their own, and near-dedup tells rows apart by a number of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.llm import langid
from frameflow.llm.common import materialise, new_path, numbered, read_table, unused
from frameflow.llm.decontam import decontaminate
from frameflow.llm.line_dedup import dedup_lines
from frameflow.llm.near import near_copies
from frameflow.llm.packing import pack
from frameflow.llm.queries import vocabulary

MIN_LANGUAGE_SCORE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of which no language is likelier than all others together."""
    model = langid.train(docs, vocabulary("piece_bpe_32k.model"))
    kept = langid.score(docs, model).where((F.col("lang_pred") != langid.UNDEFINED) & (F.col("lang_score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all; text and n_chars are made anew."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    done, dropped = dedup_lines(whole, min_chars=1, min_docs=10), F.col("n_dropped") > 0
    made = {"text": F.when(dropped, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(dropped, F.char_length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word similarity of 0.8 or more one row stays: the smallest doc_id's, null ids last.

    Candidates are SimHash groups of 3 bits and bands of minima; each link is verified."""
    row, component = unused("__row", docs.columns), unused("component", docs.columns)
    rows = numbered(docs, row)
    groups = near_copies(rows, row, shingle=5, least=0.8, bits=3).withColumnRenamed("component", component)
    placed = materialise(rows.select(row, "doc_id").join(groups, row), "groups")
    stays = placed.groupBy(component).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row))
    gone = materialise(placed.select(row).join(stays.select(row), row, "left_anti"), "gone")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lie in windows of the benchmark go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a sequence, with its token ids."""
    return pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicate_groups),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]

#: No stage but line dedup and decontamination can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, base = read_table(spark, sf_dir, "documents"), new_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
