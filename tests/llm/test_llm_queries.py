import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import DATA, connect, same  # noqa: E402

from netloom.llm import queries as llm  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, con, name):
    same(spark, llm.queries()[name], llm.oracle_sql()[name], con)


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_runs(spark, name):
    assert llm.queries()[name](spark, DATA).count() > 0
