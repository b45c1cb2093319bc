from datetime import date

from pyspark.sql import functions as F

from tallyforge.functions.normalize import account_key, iso, month_from_no, month_no, month_start, word
from tallyforge.operators.dedupe import keep_last


def test_words_and_keys(spark):
    df = spark.createDataFrame([("　ＦＲＥＥ ",), ("\tLight ",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(word(F.col("s"))).collect()] == ["free", "light", None, None]
    ids = spark.createDataFrame([(" uABCdef 　",), ("Uabcdef",), ("",), (None,)], "s string")
    assert [r[0] for r in ids.select(account_key(F.col("s"))).collect()] == ["Uabcdef", "Uabcdef", None, None]


def test_months(spark):
    df = spark.createDataFrame([(date(2024, 12, 31),), (date(2025, 1, 1),), (None,)], "d date")
    got = df.select(iso(month_start(F.col("d"))), iso(month_from_no(month_no(F.col("d"))))).collect()
    assert [tuple(r) for r in got] == [("2024-12-01", "2024-12-01"), ("2025-01-01", "2025-01-01"), (None, None)]


def test_keep_last_ties_nulls_and_clashing_names(spark, rows):
    data = [("a", 1, 5, "x"), ("a", 1, 5, "x"), ("a", 2, 7, "y"), ("a", 2, 9, "y"), ("a", None, 99, "z"), (None, 1, 1, "n"), (None, 1, 2, "n")]
    df = spark.createDataFrame(data, "k string, o int, v int, __best string")
    got = keep_last(df, {"k": F.col("k")}, [F.col("o")], {"v": F.col("v")})
    assert rows(got) == [(None, 2), ("a", 9)]
    assert rows(keep_last(df.limit(0), {"k": F.col("k")}, [F.col("o")], {"v": F.col("v")})) == []
