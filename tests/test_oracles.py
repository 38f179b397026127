"""Every registered query with SQL against DuckDB over the whole small tables."""

from __future__ import annotations

import pytest

from eventloom.plans import catalog

from conftest import canonical


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "CAR" in " ".join(__spark_entry__.entry(spark).columns).upper()
