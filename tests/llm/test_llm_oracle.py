import pytest
from compare import same

from paperloom.llm.queries import REGISTRY


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_sql(spark, data, name):
    same(spark, REGISTRY.queries[name], REGISTRY.sql[name], data)
