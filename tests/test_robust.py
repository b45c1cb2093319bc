"""The account queries over empty tables, tables with nulls everywhere, repeated rows and clashing columns."""

import os

import pytest
from pyspark.sql import functions as F

from tallyforge.queries.history_queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("account_master", "revenue_monthly", "fx_rate")
FOUND = [n for n in QUERIES if n.endswith("_found")]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def write(spark, folder, change):
    for t in TABLES:
        change(spark.read.parquet(f"{DATA}/{t}.parquet"), t).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def of(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def plain(spark):
    return {n: of(QUERIES[n](spark, DATA)) for n in FOUND}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("data")
    nulls = lambda df, _: df.unionByName(df).select(*[F.when(F.rand(i) < 0.85, F.col(c)).alias(c) for i, c in enumerate(df.columns)])
    clash = lambda df, _: df.withColumns({c: F.lit("clash") for c in ("key", "unit", "yen", "bucket", "pairs", "record", "event_no", "lag", "at", "valid_from", "newest", "period", "n", "snap_date")})
    return {
        "empty": write(spark, top / "empty", lambda df, _: df.limit(0)),
        "nulls": write(spark, top / "nulls", nulls),
        "clash": write(spark, top / "clash", clash),
        "twice": write(spark, top / "twice", lambda df, _: df.unionByName(df)),
        "no_accounts": write(spark, top / "no_accounts", lambda df, t: df.limit(0) if t == "account_master" else df),
    }


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folders, name):
    assert QUERIES[name](spark, folders["empty"]).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_anywhere(spark, folders, name):
    QUERIES[name](spark, folders["nulls"]).collect()


@pytest.mark.parametrize("name", FOUND)
def test_clashing_columns_and_repeated_rows_change_nothing(spark, folders, plain, name):
    assert of(QUERIES[name](spark, folders["clash"])) == plain[name]
    assert of(QUERIES[name](spark, folders["twice"])) == plain[name]


def test_without_accounts_every_row_is_missing(spark, folders):
    rows = QUERIES["p5_found"](spark, folders["no_accounts"])
    assert rows.count() > 0 and rows.where("reason <> 'missing'").count() == 0
    assert QUERIES["p1_found"](spark, folders["no_accounts"]).count() == 0
