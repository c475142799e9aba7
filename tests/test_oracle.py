"""Every registered query of the core equals its SQL on the smallest tables."""

import pytest

from lexweave.plans import catalog

from .oracle import DATA, compare, connection

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SMALL)


def test_all_but_the_inexpressible_have_sql():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"stem_porter", "stem_snowball"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    compare(spark, duck, name, catalog.QUERIES[name], catalog.ORACLES.get(name), SMALL)
