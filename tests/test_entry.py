"""Driver contract and oracle regression at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert {"auroc", "ap", "tp", "fp", "fn", "tn"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


SQL_QUERIES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_oracle_small(spark, con, sf_small, name):
    msg, ok = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], sf_small)
    assert ok, msg


@pytest.mark.skipif(not os.environ.get("CALLSCOPE_ORACLE_SF"), reason="set CALLSCOPE_ORACLE_SF=<sf dir> to run")
def test_oracle_at_larger_scale(spark):
    """Optional: every SQL-checked query at a larger scale factor (e.g. sf0.1)."""
    sf = os.environ["CALLSCOPE_ORACLE_SF"]
    con = duck(sf)
    bad = []
    for name, sql in E.oracle_sql().items():
        msg, ok = compare(spark, con, name, E.queries()[name], sql, sf)
        if not ok:
            bad.append(msg)
    assert not bad, bad
