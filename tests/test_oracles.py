"""Every registered query against its SQL on the smallest data set."""

import check
import pytest

from cinderlog import plans


@pytest.fixture(scope="module")
def con(sf_dir_module):
    return check.connect(sf_dir_module)


@pytest.fixture(scope="module")
def sf_dir_module():
    return "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracles())


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query_matches_sql(spark, con, sf_dir_module, name):
    result, _ = check.compare(spark, con, name, sf_dir_module)
    assert result.startswith("ok"), result


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns[:2] == ["id", "timestamp"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
