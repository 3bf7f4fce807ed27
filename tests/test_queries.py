"""Every core query runs on the smallest tables; those with SQL give the same rows."""

from __future__ import annotations

import pytest

from skysieve.plans import core_queries, more_queries, reference_queries

from .oracle import connection, same

MODULES = (core_queries, reference_queries, more_queries)
CASES = [(m, name) for m in MODULES for name in m.QUERIES]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_query(spark, sf_dir, con, module, name):
    df = module.QUERIES[name](spark, sf_dir)
    if name in module.SQL:
        same(df, con, module.SQL[name])
    else:
        assert df.count() > 0 and df.columns
