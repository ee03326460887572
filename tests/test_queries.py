"""Every query with an oracle against DuckDB on the smallest tables."""
import os

import duckdb
import pytest

from tidepool import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(columns, want.fetchall()) == rows(df.columns, got)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_successors_of_every_order(spark):
    got = catalogue.QUERIES["key_successors"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert {(r["after_hex"], r["next_hex"]) for r in got if r["after_hex"] == "4F00"} == {("4F00", "50")}  # 'O' carries


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_every_stored_key_is_found(spark):
    got = catalogue.QUERIES["kv_multi_get"](spark, SF).collect()
    assert all((r["found"] is not None) == (r["key"] >= 0) for r in got)
    assert any(r["key"] > 0 and r["key"] % 3 == 0 for r in got)
