"""Registered training-data queries against SQL on the small tables."""

import pytest

from memograph.llm.queries import ORACLES, QUERIES
from parity import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    ok, message = compare(spark, duck("/root/testdata/sf0.01"), name, QUERIES[name], ORACLES[name], "/root/testdata/sf0.01")
    assert ok, message
