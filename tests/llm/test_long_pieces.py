import public_tokenizers
from pyspark.sql import functions as F

from frameflow.llm import langid


def test_no_piece_of_the_vocabulary_is_dropped():
    pieces = langid.Pieces(langid.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    assert pieces.longest == langid.MAX_PIECE == 16 and sum(len(t) > 8 for t in pieces.texts) > 3000


def test_every_language_is_learnt(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.format_string("l%03d", F.col("id") % 220).alias("lang"))
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    want = docs.where(langid.learnable(F.col("doc_id"), 5)).select("lang").distinct().count()
    assert len(model.languages) == want > 200
