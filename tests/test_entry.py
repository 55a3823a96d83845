import importlib

import __spark_entry__ as entry


def test_queries_and_oracles_match():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    """Nothing outside the subpackage of the training-data operators imports it."""
    for name in ("operators.index", "operators.search", "operators.boolean", "operators.feedback", "operators.evaluate", "sources.trec", "sources.collections", "streaming.append", "plans.catalogue", "plans.language"):
        text = open(importlib.import_module(f"rankloom.{name}").__file__).read()
        assert "llm" not in text
