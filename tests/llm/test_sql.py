import os

import pytest

from loamline.llm import queries, sql
from tests.test_entry import FOLDER, compare, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    compare(spark, duck, name)


def test_sql_has_queries():
    assert set(sql.SQL) <= set(queries.QUERIES)
