"""Every registered query against its DuckDB oracle on sf0.001 (row count,
column names and order-insensitive values), the driver's check in small."""

import pytest

import __spark_entry__ as E
from leadflow.plans.registry import REGISTRY
from tools.oracle_check import digest

# the corpus operators' queries have tests of their own
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in REGISTRY}


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(ORACLES) <= set(qs)
    assert len(qs) >= 40


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "campaign_id" in df.columns


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    from tests.conftest import SF_SMALL
    df = E.queries()[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[key])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    h1, l1 = digest(df.columns, rows)
    h2, l2 = digest(ocols, orows)
    assert h1 == h2, (sorted(set(l1) - set(l2))[:3], sorted(set(l2) - set(l1))[:3])
