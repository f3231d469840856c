"""Every registered query against its oracle SQL on the smallest tables."""

import os

import oracle
import pytest

from specforge import catalog

catalog.load()
FOLDER = f"{oracle.BASE}/{os.environ.get('SF', 'sf0.001')}"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    ok, note = oracle.compare(spark, con, name, catalog.QUERIES[name],
                              catalog.ORACLES.get(name), FOLDER)
    assert ok, note
    if catalog.ORACLES.get(name) is None:
        pytest.skip("runs; checked on fixtures only")


def test_choose_method_all_takes_both_sides(spark):
    """On a table where some sources have few text rows."""
    folder = f"{oracle.BASE}/sf0.01"
    ok, note = oracle.compare(spark, oracle.duck(folder), "choose_method_all", catalog.QUERIES["choose_method_all"],
                              catalog.ORACLES["choose_method_all"], folder)
    assert ok, note
    assert {r.method for r in catalog.QUERIES["choose_method_all"](spark, folder).collect()} == {"text", "response"}


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
