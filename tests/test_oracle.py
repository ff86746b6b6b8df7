"""Every registered query beside its SQL twin on the smallest tables."""

import pytest
from compare import duck, run_pair

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
#: Hundreds of forests; tests/test_fits.py runs the same operators with small ones.
SLOW = {n for n in entry.queries() if n.startswith(("j11", "j4_boosted", "h13"))}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, con, name):
    status, n, _sec, note, _ = run_pair(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert status in ("ok", "rows"), note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "auc" in df.columns


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
