"""A search without a limit returns every hit, and the registered query has none."""

from webskein.operators import search
from webskein.plans import catalogue


def test_search_without_limit(spark, sf, monkeypatch):
    rows = spark.range(120).selectExpr("id", "'red fox' AS title", "'x' AS category")
    assert search.search(rows, "red fox", k=None).count() == 120 and search.search(rows, "red fox").count() == 50
    asked = []
    monkeypatch.setattr(search, "search", lambda rows, query, k=50: asked.append(k) or rows)
    catalogue.search_phrase(spark, sf)
    assert asked == [None]
