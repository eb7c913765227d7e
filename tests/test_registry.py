"""Queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from drawscope.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    want = duck.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(want.fetchall())


def test_single_draw_reaches_the_scan(spark, tmp_path):
    from drawscope.operators import ensembles
    from drawscope.plans import electorate

    electorate.ensemble(spark, FOLDER).write.parquet(f"{tmp_path}/e")
    plan = ensembles.single_draw(spark.read.parquet(f"{tmp_path}/e"), 3)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(draw), EqualTo(draw,3)]" in plan and "chain" not in plan.split("ReadSchema")[1].split("\n")[0]
