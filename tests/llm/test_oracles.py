"""Training-data queries that SQL can express."""

import pytest

from arcweft.llm import queries
from compare import both, connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    got, want = both(connection(SF), queries.queries()[name](spark, SF), queries.oracle_sql()[name])
    assert got == want
