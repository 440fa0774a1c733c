"""Every query equals its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from voxelith.plans.queries import ORACLES, QUERIES, SLOW

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(it):
    return sorted((tuple(round(v, 5) + 0.0 if isinstance(v, float) else str(v) for v in map(lambda x: float(x) if hasattr(x, "is_integer") and not isinstance(x, int) else x, r)) for r in it), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES | SLOW))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute((ORACLES | SLOW)[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.select(*names).collect()) == rows(cur.fetchall())
