"""Every named query of the subpackage on the smallest tables, with its SQL where there is one."""

import os

import pytest

from spangraph.llm.queries import ORACLE, QUERIES

from ..conftest import DATA, same_rows

SMALL = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE:
        same_rows(df, ORACLE[name], SMALL)
    else:
        rows = df.collect()
        assert rows and len(set(map(str, rows))) == len(rows)
