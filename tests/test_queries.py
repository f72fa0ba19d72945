"""Every registered query of the library against its SQL on the small tables."""

import pytest
from oracle import connect, rows

from mnemospark import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = registry.QUERIES[name](spark, sf_dir)
    assert len(set(got.columns)) == len(got.columns)
    got = got.toPandas()
    if name not in registry.SQL:
        assert len(got) > 0
        return
    want = con.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0


def test_entry_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "_LLM", False)
    monkeypatch.setattr(e, "_PIPELINE", False)
    assert set(e.queries()) == set(registry.QUERIES) and set(e.oracle_sql()) == set(registry.SQL)
