"""The registered queries of the llm operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, scratch
from .embedding_dedup import near_vectors
from .fingerprints import encode, fingerprint_edits
from .jaccard_join import jaccard_components
from .mixing import mix_sources
from .packing import pack_batches
from .quality import quality
from .secret_scan import RULES, joined, scan_secrets
from .sharding import hilbert_shards
from .token_counts import BytePairs, Words, token_rollup
from .toxicity import toxicity

#: Where the public vocabularies lie, on the driver.
TOKENIZERS = "/opt/tokenizers"

Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("matches").alias("n_matches"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_edits(read_table(spark, sf_dir, "documents"))
    return found.withColumns({"fingerprint": encode(F.col("sketch")), "edited_fingerprint": encode(F.col("edited_sketch"))}).drop("sketch", "edited_sketch")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.3)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    subwords = BytePairs("byte-bpe-50k", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return token_rollup(read_table(spark, sf_dir, "documents"), scratch(spark, "ledger"), subwords, Words("words-1"), Words("letters-2", r"\p{L}+"))


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_batches(read_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents")).select("doc_id", "spans")
    count = lambda i: F.size(F.filter("spans", lambda s: s["place"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["place"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = hilbert_shards(read_table(spark, sf_dir, "documents"), n_shards=24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix aims at: a row for each source."""
    found = mix_sources(read_table(spark, sf_dir, "documents"))
    return found.groupBy("source", "source_size", "target").agg(F.count("*").alias("n_docs"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the fingerprints that SQL can work out."""
    return fingerprint_edits(read_table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


def word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ledger with tokenizers that SQL has, too."""
    return token_rollup(read_table(spark, sf_dir, "documents"), scratch(spark, "ledger"), Words("words-0"), Words("words-1"), Words("letters-2", r"\p{L}+"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_jaccard_join, op2_toxicity, op3_mix_sources, op4_fingerprints, op5_quality, op6_token_counts, op7_length_buckets, op8_secret_scan, op9_embedding_dedup, op10_hilbert_shards, mix_targets, edited_texts, word_rollup)}
ORACLES: dict[str, str] = {
    # Pairs come from shared shingles, counted; components by walking the links.
    "op1_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS shingle
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
        ), n AS (
            SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)
        ), reach(doc_id, seen) AS (
            SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen
        ), least AS (
            SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1
        ), texts AS (
            SELECT doc_id, CASE WHEN count(shingle) > 0 THEN string_agg(shingle, chr(1) ORDER BY shingle) END AS whole
            FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
        )
        SELECT n.doc_id, n.n AS n_shingles, component_id,
               CASE WHEN whole IS NULL THEN n.doc_id ELSE min(n.doc_id) OVER (PARTITION BY whole) END AS class_id, coalesce(l.c, 0)::BIGINT AS n_links
        FROM n JOIN least USING (doc_id) JOIN texts USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS c FROM links GROUP BY 1) l USING (doc_id)
    """,
    # Every pair, in double precision; components by walking the links.
    "op9_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        ), ok AS (
            SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND list_max(list_transform(e, lambda x: abs(x))) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach(vec_id, seen) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.seen
        ), least AS (
            SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY 1
        ), n AS (
            SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1
        )
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM least LEFT JOIN n USING (vec_id)
    """,
}

def _spans_sql() -> str:
    """Each rule's matches by the lengths of what lies between them and of themselves, added up."""
    parts = []
    for place, rule in enumerate(RULES):
        rx = rule.regex.replace("'", "''")
        parts.append(f"""
            SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, e[i] - length(m[i]) AS start, e[i] AS "end" FROM (
                SELECT doc_id, m, v, list_transform(range(1, len(m) + 1), lambda k: list_sum(list_transform(g[1:k], lambda x: length(x))) + list_sum(list_transform(m[1:k], lambda x: length(x)))) AS e, unnest(range(1, len(m) + 1)) AS i
                FROM (SELECT doc_id, regexp_extract_all(t, '{rx}', 0) AS m, regexp_extract_all(t, '{rx}', {rule.group}) AS v, string_split_regex(t, '{rx}') AS g FROM d)
            ) WHERE length(v[i]) >= {rule.least}""")
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}), joined AS (
            SELECT doc_id, count(*) FILTER (WHERE place = 0) AS a, count(*) FILTER (WHERE place = 1) AS b, count(*) FILTER (WHERE place = 2) AS c,
                   string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, place) AS spans, string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, place) FILTER (WHERE place < 3) AS base
            FROM s GROUP BY 1
        )
        SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN joined USING (doc_id)"""


ORACLES["op8_secret_scan"] = _spans_sql()
# The water level: sources fill up in order of capacity by weight, and what they leave goes to the rest by weight.
ORACLES["mix_targets"] = r"""
    WITH s AS (
        SELECT source, sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS words, count(*) AS n_docs FROM documents GROUP BY 1
    ), w AS (
        SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w, 3.0::DOUBLE * words AS cap FROM s
    ), o AS (
        SELECT *, sum(words) OVER () AS total, coalesce(sum(cap) OVER by_level, 0) AS below, sum(w) OVER () - coalesce(sum(w) OVER by_level, 0) AS rest FROM w
        WINDOW by_level AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), l AS (
        SELECT min((total - below) / rest) FILTER (WHERE (total - below) / rest * w <= cap) AS level FROM o
    )
    SELECT source, words::BIGINT AS source_size, coalesce(least(level * w, cap), cap) AS target, n_docs FROM o, l
"""
ORACLES["edited_texts"] = """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), o AS (
        SELECT doc_id, t, length(t)::BIGINT AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nxt FROM t
    )
    SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 3) || substr(nxt, 1, n // 3)) AS edited_sha256 FROM o
"""
ORACLES["word_rollup"] = r"""
    SELECT source, lang, version, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM (
        SELECT source, lang, 'words-0' AS version, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents d WHERE text IS NULL OR doc_id = (SELECT min(doc_id) FROM documents e WHERE e.text = d.text)
        UNION ALL
        SELECT source, lang, 'letters-2', coalesce(len(regexp_extract_all(text, '\p{L}+')), 0) FROM documents d WHERE text IS NULL OR doc_id = (SELECT min(doc_id) FROM documents e WHERE e.text = d.text)
    ) GROUP BY 1, 2, 3
"""
