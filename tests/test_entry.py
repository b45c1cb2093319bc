import os

import pytest

import __spark_entry__ as entry
from tallyforge.queries import history_queries, metric_queries

DATA = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in range(1, 8):
        assert f"p{n}_found" in history_queries.QUERIES
    assert len(metric_queries.ORACLE) >= len(metric_queries.QUERIES) - 4


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["metric_time__month", "order_value"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted({**history_queries.QUERIES, **metric_queries.QUERIES}))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    queries, sql = {**history_queries.QUERIES, **metric_queries.QUERIES}, {**history_queries.ORACLE, **metric_queries.ORACLE}
    df = queries[name](spark, DATA)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((str(tuple(map(plain, r))) for r in df.select(*[f"`{c}`" for c in cols]).collect()))
    if name not in sql:
        assert got
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    r = con.execute(sql[name])
    names = [c[0] for c in r.description]
    want = sorted(str(tuple(plain(row[names.index(c)]) for c in cols)) for row in r.fetchall())
    assert sorted(names) == cols and got == want


@pytest.mark.parametrize("name", ["s4_create_schema", "s5_create_table_as", "s6_session"])
@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_catalogue_queries_need_no_other(spark, name):
    """Each by itself, in a catalogue without the schemas that other queries make, and twice in a row."""
    duckdb = pytest.importorskip("duckdb")
    for schema in ("raw", "loader"):
        spark.sql(f"DROP DATABASE IF EXISTS {schema} CASCADE")
    con = duckdb.connect()
    con.execute(f"create view nation as select * from '{DATA}/nation.parquet'")
    want = sorted(con.execute(metric_queries.ORACLE[name]).fetchall())
    for _ in range(2):
        df = metric_queries.QUERIES[name](spark, DATA)
        assert sorted(tuple(r) for r in df.collect()) == want and spark.catalog.currentDatabase() == "default"
