"""The registered llm queries: against SQL where there is some, and their shape."""

import pytest
from helpers import canonical

from webskein.llm import queries

COLUMNS = {
    "op1_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op4_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op5_quality": {"doc_id", "held_out", "score", "predicted"},
    "op6_token_counts": {"source", "lang", "version", "docs", "tokens"},
    "op7_length_buckets": {"doc_id", "length", "bucket", "batch"},
    "op8_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op9_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op10_hilbert_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(name, spark, sf, duck):
    assert canonical(queries.QUERIES[name](spark, sf).toPandas()) == canonical(duck.execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_each(name, spark, sf):
    found = queries.QUERIES[name](spark, sf)
    assert COLUMNS[name] <= set(found.columns)
    table = {"op9_embedding_dedup": "embeddings"}.get(name, "documents")
    if name != "op6_token_counts":
        assert found.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
