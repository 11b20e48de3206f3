import os

import pytest

from sparkloom import registry
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        compare(df, con, registry.oracle_sql()[name])
    else:
        assert df.count() > 0
