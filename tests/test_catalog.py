"""Every query against its SQL on the smallest tables."""

import re

import pytest
from compare import database, differences

from tsubo.plans.catalog import CATALOG

SURVEYED = {"S": 10, "P": 10, "J": 10, "A": 17, "W": 10, "O": 7, "U": 4, "F": 26, "X": 11, "M": 17, "T": 5, "R": 5}


@pytest.fixture(scope="module")
def con(folder):
    return database(folder)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_sql(name, spark, folder, con):
    query = CATALOG[name]
    assert differences(query.run(spark, folder), con.sql(query.sql)) == []


def test_every_operator_has_a_query():
    have = {m[0] for m in (re.match(r"[a-z]\d+", n) for n in CATALOG) if m}
    want = {f"{letter.lower()}{i}" for letter, n in SURVEYED.items() for i in range(1, n + 1)}
    assert want - have == set()


def test_entry_points(spark, folder):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns == ["id", "title", "rent"]
