"""The llm queries that SQL can express equal it on the smallest tables."""

import pytest

from lexweave.llm import queries

from ..oracle import DATA, compare, connection

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    compare(spark, duck, name, queries.QUERIES[name], queries.ORACLES.get(name), SMALL)


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).parents[2] / "lexweave"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
