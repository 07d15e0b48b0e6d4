"""The subpackage's queries that SQL can hold against, with DuckDB over the smallest tables."""

import os

import pytest

from lorekiln.llm import catalogue
from tests.test_queries import DATA, duck, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):  # noqa: F811
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert len(want) and sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
