"""Every query that has an oracle gives the oracle's rows on the small tables; the others run and have rows."""

import os

import pytest

from gazette.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the provided tables are absent")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_are_the_oracles(spark, con, name):
    oracle.compare(spark, con, catalog.QUERIES[name], catalog.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_others_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
