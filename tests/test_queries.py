"""Every query with SQL against that SQL; the others run and keep their schema."""

import pytest

from tests.conftest import DATA
from tidewake.plans import diel, frames, misc, windows

QUERIES = diel.QUERIES | windows.QUERIES | frames.QUERIES | misc.QUERIES
ORACLES = diel.ORACLES | windows.ORACLES | frames.ORACLES | misc.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
