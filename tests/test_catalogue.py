"""Every registered analytics query against DuckDB's answer, or at least for running."""

import pytest
from helpers import canonical

from webskein.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(name, spark, sf, duck):
    assert canonical(catalogue.QUERIES[name](spark, sf).toPandas()) == canonical(duck.execute(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert "top_resources" in entry.queries() and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_inflated_bodies_of_null_props(spark, tmp_path):
    """The query's own function resolves its annotations, and a null stays null."""
    spark.createDataFrame([(1, "a"), (2, '{"k": 1}'), (3, None), (4, None)], "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(catalogue.QUERIES["inflated_bodies"](spark, str(tmp_path)).collect()) == [(1, "a"), (2, '{"k": 1}'), (3, None), (4, None)]
