"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from linkloom.plans import queries
from linkloom.plans import function_queries, page_queries, view_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, tmp_path, name):
    df = queries.QUERIES[name](spark, sf)
    df.write.parquet(str(tmp_path / "out"))
    duck.execute(f"create or replace table o as {queries.ORACLE_SQL[name]}")
    duck.execute(f"create or replace table s as select * from '{tmp_path}/out/*.parquet'")
    columns = sorted(r[0] for r in duck.execute("describe o").fetchall())
    assert columns == sorted(df.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("s", "o"), ("o", "s")):
        assert duck.execute(f"select {listed} from {a} except all select {listed} from {b}").fetchall()[:3] == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["token_blocking", "fuzzy_dictionary"])
def test_no_nested_loops(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
