"""Every query with SQL gives the rows of its SQL."""

import pytest
from compare import differences, duck
from storyloom.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_rows(spark, con, name):
    sql = registry.oracle_sql().get(name)
    if sql:
        assert differences(spark, SMALL, name, registry.queries()[name], sql, con) == ""
    else:
        registry.queries()[name](spark, SMALL).count()
