from __future__ import annotations

import pytest
from oracle import same

import __spark_entry__
from ledgerleaf.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_sql_gives(name, spark, data):
    same(QUERIES[name], SQL[name], spark, data)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry():
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_registry_without_the_training_data_part(monkeypatch):
    import sys

    for name in ("ledgerleaf.llm", "ledgerleaf.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    assert __spark_entry__.queries().keys() == QUERIES.keys()
    assert __spark_entry__.oracle_sql().keys() == SQL.keys()
