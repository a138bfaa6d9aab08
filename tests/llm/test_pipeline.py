"""Stages of the pipeline on the smallest tables, each against what it must leave."""

import corpus_pipeline
from holdfast.llm import queries
from tests.conftest import DATA


def test_stages(spark):
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        out = stage(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        assert 0 < docs.count() <= before
    assert docs.select("doc_id").distinct().count() == docs.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {r.doc_id for r in docs.collect()}


def test_queries_are_numbered():
    assert [n.split("_")[0] for n in queries.QUERIES][:10] == [f"op{k}" for k in range(1, 11)] and "pipeline" in queries.QUERIES
