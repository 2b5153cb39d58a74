"""The pipeline: each stage on its own input, and the whole."""

import corpus_pipeline as P
from caseloom.llm import queries, simhash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [k for k, _ in P.STAGES] == ["toxicity", "line dedup", "near copies", "mixing", "packing"]
    for name, stage in P.STAGES:
        before = docs.count()
        docs = stage(spark, docs, sf).cache()
        if name != "packing":
            assert docs.columns == columns and docs.count() > 0
        if name == "line dedup":
            assert docs.count() == before and docs.where("n_chars <> length(text)").count() == 0
        if name == "near copies":
            assert simhash.near_duplicates(docs).where("doc_id <> component_id").count() == 0
    assert docs.count() > 0


def test_run_and_queries(spark, sf):
    assert P.run(spark, sf).count() > 0
    assert len([k for k in queries.QUERIES if k.startswith("op")]) == 13
