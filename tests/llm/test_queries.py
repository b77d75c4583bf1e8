"""The queries of this subpackage against their SQL on the smallest tables."""

import pytest

from curvespark.llm.queries import ORACLE_SQL, QUERIES
from tests.test_entry import DATA, plain, sql  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sql, name):  # noqa: F811
    got, want = QUERIES[name](spark, DATA).toPandas(), sql.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
