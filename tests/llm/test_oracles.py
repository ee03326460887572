"""Queries of the subpackage with SQL, against DuckDB on the smallest tables."""
import os

import pytest

from tests.test_queries import SF, con, rows  # noqa: F401

queries = pytest.importorskip("tidepool.llm.queries")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, con, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    got, want = df.collect(), con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got and rows(columns, want.fetchall()) == rows(df.columns, got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_planted_copies_are_linked(spark):
    got = queries.lattice_dedup_planted(spark, SF).collect()
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len(got) == 4 * n and sum(r["n_links"] for r in got) >= 6 * n
