"""Every registered query that has a SQL counterpart gives exactly the same rows as DuckDB."""

from __future__ import annotations

import pytest
from compare import difference
from conftest import SF

from catalog import all_oracles, all_queries

ORACLES = all_oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    assert difference(all_queries()[name](spark, SF), duck, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(all_queries())


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
