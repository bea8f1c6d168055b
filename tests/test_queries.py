"""Every query of the core against its SQL on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from factloom.plans import flows, inventory, maintenance, oracles, problems, reference

SF = "/root/testdata/sf0.001"
QUERIES = reference.QUERIES | inventory.QUERIES | maintenance.QUERIES | flows.QUERIES | problems.QUERIES
ORACLES = oracles.ORACLES | inventory.ORACLES | maintenance.ORACLES | flows.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = Counter(tuple(plain(v) for v in r) for r in got.select(*columns).collect())
    if name in ORACLES:
        theirs = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
        assert mine == Counter(tuple(plain(v) for v in r) for r in theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
