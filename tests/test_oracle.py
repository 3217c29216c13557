"""Every named query against its SQL, on all rows of the smallest tables."""
import pytest
from oracle_check import TESTDATA, compare

import __spark_entry__ as entry
from reeltide.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def test_names_match():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    verdict, count, note = compare(spark, f"{TESTDATA}/sf0.001", name, QUERIES[name], ORACLE.get(name))
    assert verdict in ("ok", "rows"), f"{verdict}: {note}"
