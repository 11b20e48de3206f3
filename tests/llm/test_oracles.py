import os

import pytest

from sparkloom.llm import queries
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_twin(spark, name):
    compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])
