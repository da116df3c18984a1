import corpus_pipeline
from frameflow.llm.common import materialise


def test_stages_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns and made.dtypes == docs.dtypes
        docs = materialise(made, "stage")
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r[0] for r in pieces.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_run_keeps_documents_that_only_differ(spark, sf):
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.select("doc_id").distinct().count() > 100


def test_edge_cases(spark, edge_docs, no_docs, sf):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf)
            made.collect()
            if "sequence_id" not in made.columns:
                assert made.columns == docs.columns
