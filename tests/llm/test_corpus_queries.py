"""The corpus queries that SQL can express, on the smallest tables."""

from pathlib import Path

import oracle
import pytest

from conceptloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_agree_with_sql(spark, name):
    assert oracle.difference(spark, DATA, name) is None
