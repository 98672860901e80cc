"""Every graph query against its SQL."""

import pytest

from arcweft import catalogue
from compare import both, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, con, name):
    got, want = both(con, catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 116
