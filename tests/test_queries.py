"""Every query that has SQL gives what DuckDB gives; the others run."""

from __future__ import annotations

import pytest
from compare import rows_of

from variorum import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, oracle):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = oracle.execute(catalogue.ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))


def test_entry(spark):
    assert catalogue.entry(spark).limit(1).count() == 1
