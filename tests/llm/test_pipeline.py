"""The pipeline against its stages taken one by one, on the smallest tables."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_stages(spark):
    import corpus_pipeline
    from tessera.llm import decontamination, minhash_dedup, mixing, toxicity

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    docs = stages["toxicity"](spark, before, FOLDER).cache()
    assert docs.columns == columns
    assert ids(docs) == ids(toxicity.toxicity_scores(before, labels).filter("predicted = 0"))
    before, docs = docs, stages["near_dedup"](spark, docs, FOLDER).cache()
    assert docs.columns == columns and ids(docs) == ids(minhash_dedup.near_duplicates(before).filter("kept"))
    before, docs = docs, stages["decontamination"](spark, docs, FOLDER).cache()
    assert docs.columns == columns and ids(docs) == ids(decontamination.decontaminate(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).filter("not contaminated"))
    before, docs = docs, stages["mixing"](spark, docs, FOLDER).cache()
    times = {r.doc_id: round(r.taken / r.size) for r in mixing.mix_sources(before).collect() if r.size}
    assert docs.columns == columns and ids(docs) == sorted(i for i, n in times.items() for _ in range(n))
    out = stages["sharding"](spark, docs, FOLDER)
    assert ids(out) == ids(docs) and ids(corpus_pipeline.run(spark, FOLDER)) == ids(out)
