"""Phrase search with a prefix on the last word, BM25 ranks and snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
TOKENS = r"(?U)(\w+)"


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(1)), F.array().cast("array<string>"))


def _hits(tokens: Column, terms: list[str]) -> Column:
    """The places, from 1, where the phrase begins."""
    last = len(terms) - 1

    def at(i: Column) -> Column:
        ok = F.get(tokens, i + (last - 1)).startswith(terms[last])
        for k in range(last):
            ok = ok & (F.get(tokens, i + (k - 1)) == terms[k])
        return F.coalesce(ok, F.lit(False))

    n = F.size(tokens) - last
    return F.when(n >= 1, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at)).otherwise(F.array().cast("array<int>"))


def search(rows: DataFrame, query: str, columns: tuple[str, ...] = ("title", "category"), key: str = "id", k: int | None = 50, window: int = 15) -> DataFrame:
    """key, rank_score (higher is better) and snippet of the k best rows that hold the phrase in one column; k None: of all.

    A trailing star of the query is dropped: its last word is always a prefix. The phrase
    counts as one term: its frequency over all columns, its document frequency and the
    average length give BM25. A query without words finds nothing.
    """
    terms = re.findall(r"\w+", query.lower())
    made = rows.select(key, *[_tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)], F.col(columns[0]).alias("__first"))
    if not terms:
        return made.where("false").select(key, F.lit(0.0).alias("rank_score"), F.lit("").alias("snippet"))
    hits = made.withColumns({f"h{i}": _hits(F.col(f"t{i}"), terms) for i in range(len(columns))})
    tf = sum((F.size(f"h{i}") for i in range(len(columns))), F.lit(0))
    length = sum((F.size(f"t{i}") for i in range(len(columns))), F.lit(0))
    hits = hits.select(key, "t0", "h0", tf.alias("tf"), length.alias("len"))
    totals = F.broadcast(hits.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), F.count_if(F.col("tf") > 0).alias("df")))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    first = F.get("h0", F.lit(0))
    start = F.greatest(F.lit(1), first - 5)
    end = start + (window - 1)
    marked = F.transform("t0", lambda w, i: F.when((i + 1 >= first) & (i + 1 < first + len(terms)), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    cut = F.array_join(F.slice(marked, start, window), " ")
    snippet = F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(F.size("t0") > end, "...").otherwise(""))
    found = hits.where("tf > 0").join(totals).withColumn("rank_score", F.round(score, 6))
    snippet = F.when(first.isNull(), F.array_join(F.slice("t0", 1, window), " ")).otherwise(snippet)
    ranked = found.select(key, "rank_score", snippet.alias("snippet")).orderBy(F.desc("rank_score"), key)
    return ranked if k is None else ranked.limit(k)
