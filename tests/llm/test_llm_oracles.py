import os

import pytest
from oracle import SF, connect, rows_of_spark, rows_of_sql

from corvane.llm import queries as Q

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert rows_of_spark(Q.QUERIES[name](spark, SF)) == rows_of_sql(connect(SF), Q.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_other_queries_run(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
