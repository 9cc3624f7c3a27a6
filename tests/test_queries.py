"""Every registered query against its SQL, at the smallest scale."""

import pytest

from ethoflow.plans import registry
from tests.oracle import compare, duck

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.ORACLES:
        compare(spark, registry.QUERIES[name], registry.ORACLES[name], DIR, con)
    else:
        df = registry.QUERIES[name](spark, DIR)
        assert len(set(df.columns)) == len(df.columns) and df.count() > 0
