"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

from packspark.plans.catalog import REGISTRY
from packspark.plans.verify import compare, duck_conn

from conftest import SF_SMALL

NAMES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    q = REGISTRY[name]
    sp = q.spark(spark, SF_SMALL).toPandas()
    if q.sql is None:
        assert list(sp.columns) == [c.split(":")[0].strip() for c in q.cols.split(",")]
        return
    dk = con.execute(q.oracle()).df()
    err = compare(sp, dk)
    assert err is None, err


def test_every_query_has_inventory_ids():
    for q in REGISTRY.values():
        assert q.ids, q.name


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
