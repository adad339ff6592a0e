import pytest

import __spark_entry__ as contract
import check
from tests.conftest import SMALL
from workload.queries import QUERIES

NO_SQL = {"a4_seq_mean", "c3_basic_similarity", "c8_plot_points", "f11_seq_ratio", "f12_raw_similarity", "f27_pca"}


@pytest.fixture(scope="module")
def database():
    return check.database(SMALL)


def test_every_query_but_the_known_ones_has_sql():
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) - set(contract.oracle_sql()) == NO_SQL
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    result = check.compare(spark, database, name, SMALL)
    assert not result.startswith("FAIL"), result


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
