"""Every registered query of the terminology engine against its SQL, on the smallest tables."""

from pathlib import Path

import oracle
import pytest

from conceptloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_agree_with_sql(spark, name):
    assert oracle.difference(spark, DATA, name) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_the_others_have_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["concept", "axis", "filler", "most_specific", "needs_review", "grp"]
