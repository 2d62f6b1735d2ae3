"""Every registered query against its SQL on the smallest tables; the others for rows and schema."""

import pytest

from framesift.plans import all_queries, flagship
from tests.oracle import assert_same, connect

QUERIES, ORACLES = all_queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_flagship(spark, sf_dir):
    found = flagship(spark, sf_dir)
    assert found.columns == ["frame_id", "label", "n", "best", "area"]
    assert found.count() > 0
