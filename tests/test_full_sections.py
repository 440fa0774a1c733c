"""Full sections: packed with air in their palette, read back even where one state alone fills them."""

import duckdb
import pytest

from voxelith.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module", params=[1, 3])
def folder(request, tmp_path_factory):
    """Lines that fill the box of the blocks, each with as many states as the parameter says."""
    at = tmp_path_factory.mktemp("full")
    duckdb.sql(f"copy (select 7 * a + (a + b + c) % {request.param} as l_orderkey, c + 61 as l_partkey, b as l_suppkey, a + 1.0 as l_quantity from range(50) p(a), range(45) q(b), range(61) r(c)) to '{at}/lineitem.parquet'")
    return str(at)


@pytest.mark.parametrize("name", ["packed_sections", "unpacked_sections"])
def test_full_sections_equal_the_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
    sql = ORACLES[name]
    con.execute(f"create table wanted as {sql}")
    names = [d[0] for d in con.execute("select * from wanted").description]
    got = sorted(map(tuple, QUERIES[name](spark, folder).select(*names).collect()))
    assert got == sorted(con.execute("select * from wanted").fetchall())
