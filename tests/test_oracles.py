import os

import pytest
from oracle import SF, connect, rows_of_spark, rows_of_sql

from corvane.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert rows_of_spark(catalog.queries()[name](spark, SF)) == rows_of_sql(connect(SF), catalog.oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
