"""Every core query with SQL gives the same rows as its SQL; the others run."""

import pytest
from compare import same

from paperloom.plans.catalog import core


@pytest.mark.parametrize("name", sorted(core.sql))
def test_sql(spark, data, name):
    same(spark, core.queries[name], core.sql[name], data)


@pytest.mark.parametrize("name", sorted(set(core.queries) - set(core.sql)))
def test_runs(spark, data, name):
    assert core.queries[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
