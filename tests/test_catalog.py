"""Every query of the library against its SQL, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from tandemetry.plans import catalog

from .parity import assert_same, connect

SF = "/root/testdata/sf0.001"
ROWS_ONLY = ["proportional_bias_p", "nested_ridge", "permutation_null", "model_metrics", "long_lowpass"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_parity(spark, con, name):
    assert_same(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
