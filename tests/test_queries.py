"""Every general query against its SQL, on the smallest tables."""

import compare
import pytest

from keyquarry.plans import details, oracles, problems, snapshots

SMALL = f"{compare.DATA}/sf0.001"
QUERIES = problems.QUERIES | snapshots.QUERIES | details.QUERIES
SQL = oracles.SQL | snapshots.SQL | details.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    columns, named, got, want = compare.both(spark, QUERIES[name], SQL[name], SMALL)
    assert columns == named and got == want


def test_all_are_registered(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 25


def test_found_come_from_the_full_results(spark):
    """What p1_found and p7_found tell is what the wide table and the changes hold."""
    wide = problems.p1_wide(spark, SMALL)
    names = [c for c in wide.columns if c not in ("snap_id", "db", "key")]
    cells = {(r["snap_id"], r["db"], r["key"], a) for r in wide.collect() for a in names if r[a] is not None}
    assert cells == {tuple(r) for r in problems.p1_found(spark, SMALL).select("snap_id", "db", "key", "attr").collect()}
