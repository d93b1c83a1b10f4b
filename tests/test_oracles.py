"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare

from evalspark.plans import catalog

NAMES = sorted(catalog.QUERIES)


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck_small, name):
    res = compare(spark, duck_small, name, SF_SMALL)
    assert res.get("match"), res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["run_id", "metric_group", "metric", "value"]
    assert df.count() > 0
