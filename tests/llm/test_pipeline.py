"""The stages in order, each on what the one before kept."""

import corpus_pipeline
from webskein.llm.common import materialize
from webskein.llm.jaccard_join import jaccard_components
from webskein.llm.secret_scan import scan_secrets
from webskein.llm.toxicity import learn


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, sf), "test")
        if name != "packing":
            assert made.columns == columns
        if name == "toxicity":
            model = learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            wanted = {r["doc_id"] for r in docs.collect() if model.score(model.total(r["text"])) < 0.5}
            assert {r["doc_id"] for r in made.collect()} == wanted
        if name == "near_duplicates":
            found = jaccard_components(docs, 5, 80).collect()
            assert {r["doc_id"] for r in made.collect()} == {r["component_id"] for r in found}
        if name == "secrets":
            assert made.count() == docs.count()
            assert all(not r["spans"] for r in scan_secrets(made).collect())
        if name == "mixing":
            assert {r["doc_id"] for r in made.collect()} <= {r["doc_id"] for r in docs.collect()}
        if name == "packing":
            assert sorted(r["doc_id"] for r in made.collect()) == sorted(r["doc_id"] for r in docs.collect())
        docs = made
    assert corpus_pipeline.ORACLE_SQL is None
