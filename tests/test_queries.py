import duckdb
import pytest

import __spark_entry__ as entry
from gridlore.plans import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    out = QUERIES[name](spark, DIR)
    columns = sorted(out.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert plain(tuple(r[c] for c in columns) for r in out.collect()) == plain(duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans_stay_in_the_engine(spark):
    for name in ("water_topk", "way_length", "bridge_semi", "bridge_overlay", "gauss_smooth", "boundary_edges"):
        plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_pushdown(spark):
    plan = QUERIES["highway_isin"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in plan
