"""Every registered query against DuckDB, or at least run."""

import pytest

from tessera.plans import registry

from . import oracle

WITH_SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(WITH_SQL))
def test_oracle(spark, sf_dir, con, name):
    columns, ours, theirs = oracle.differences(registry.queries()[name](spark, sf_dir), con, WITH_SQL[name])
    assert columns is None, columns
    assert not ours and not theirs, (ours, theirs)


@pytest.mark.parametrize("name", sorted(set(registry.ALL) - set(WITH_SQL)))
def test_runs(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)
