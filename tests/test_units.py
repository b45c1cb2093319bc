from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.units import MONEY_PRIOR, to_yen, unit_of


@pytest.mark.parametrize(
    ("currency", "remark", "want"),
    [
        ("JPY", None, ("JPY", 0)), (" ｊｐｙ ", None, ("JPY", 0)), ("¥", None, ("JPY", 0)), ("kJPY", None, ("JPY", 3)), ("JPY (000)", None, ("JPY", 3)), ("JPY X1000", None, ("JPY", 3)), ("JPY 10,000s", None, ("JPY", 4)),
        ("１０ｋ ＪＰＹ", None, ("JPY", 4)), ("百万円", None, ("JPY", 6)), ("JPY mn", None, ("JPY", 6)), ("U.S. dollars", None, ("USD", 0)), ("USD/100", None, ("USD", -2)), ("USD cents", None, ("USD", -2)), ("¢", None, ("USD", -2)),
        (None, None, None), ("", "", None), ("??", "hello", None), ("n/a", None, None), ("---", None, None),
        ("JPY", "Amounts in cents", ("USD", -2)), ("JPY", "単位：千円", ("JPY", 3)), ("JPY", "#31843 ドル建て", ("USD", 0)), ("USD", "千円単位で送付", ("JPY", 3)), ("JPY", "1 = 1,000 JPY, see ticket 47754", ("JPY", 3)),
        ("JPY", "minor units (1/100 dollar)", ("USD", -2)), ("JPY", "unit is ten thousand yen", ("JPY", 4)), ("JPY", "値は百万円", ("JPY", 6)), ("JPY", "invoice was in USD, booked in yen", ("JPY", 0)),
        ("USD", "1,000 free messages not billed", ("USD", 0)), ("JPY", "請求書 10万円超のため要確認", ("JPY", 0)), ("JPY", "resent, first file stopped at 1,000 rows", ("JPY", 0)), ("JPY", "top 1000 account", ("JPY", 0)), ("JPY", "rounded to whole yen, no cents", ("JPY", 0)), ("JPY", "千件分のメッセージを含む", ("JPY", 0)),
    ],
)
def test_units(currency, remark, want):
    assert unit_of(currency, remark) == want


@pytest.mark.parametrize(
    ("currency", "want"),
    [
        ("EUR", ("EUR", 0)), ("k€", ("EUR", 3)), ("ユーロ", ("EUR", 0)), ("euro cents", ("EUR", -2)), ("GBP", ("GBP", 0)), ("pence", ("GBP", -2)), ("CNY", ("CNY", 0)), ("人民元", ("CNY", 0)), ("KRW", ("KRW", 0)), ("億ウォン", ("KRW", 8)),
        ("HK$", ("HKD", 0)), ("A$", ("AUD", 0)), ("C$", ("CAD", 0)), ("CAD dollars", ("CAD", 0)), ("canadian dollars", ("CAD", 0)), ("hong kong dollars", ("HKD", 0)), ("豪ドル", ("AUD", 0)), ("US$ thousand", ("USD", 3)),
        ("兆円", ("JPY", 12)), ("十億円", ("JPY", 9)), ("百億円", ("JPY", 10)), ("千億円", ("JPY", 11)), ("十万円", ("JPY", 5)), ("thousand billion yen", ("JPY", 12)), ("cents /1000", ("USD", -5)), ("円（税込）", ("JPY", 0)),
        ("groats", ("UNKNOWN", 0)), ("XQ$", ("UNKNOWN", 0)), ("qjpy", ("UNKNOWN", 0)), ("rows", ("UNKNOWN", 0)), ("₿", ("UNKNOWN", 0)), ("7", ("UNKNOWN", 0)),
    ],
)
def test_units_that_are_not_yen_or_dollars(currency, want):
    assert unit_of(currency, None) == want
    assert unit_of(currency, "単位：千円") == ("JPY", 3)  # a stated unit goes before it


def test_priors_settle_ambiguous_texts():
    for text, lead, want in (("¥", {"CNY": 3.0}, ("CNY", 0)), ("thousand $", {"AUD": 3.0}, ("AUD", 3)), ("k dollars", {"CAD": 3.0}, ("CAD", 3)), ("cents", {"EUR": 3.0}, ("EUR", -2)), ("pounds", {"MASS": 3.0}, ("MASS", 0))):
        usual = unit_of(text, None)
        assert usual[0] in ("JPY", "USD", "GBP") and usual != want and usual[1] == want[1]
        assert unit_of(text, None, {**MONEY_PRIOR, **lead}) == want
    assert unit_of(None, "amounts in pounds", {**MONEY_PRIOR, "MASS": 3.0}) == ("MASS", 0)
    assert unit_of(None, "stated in 件", {"COUNT": 2.0}) == ("COUNT", 0) and unit_of(None, "stated in 件") is None


def test_long_text_is_read_whole():
    assert unit_of("JPY", "x " * 20_000 + "amounts in cents") == ("USD", -2)


def test_to_yen(spark, rows):
    rates = spark.createDataFrame([(date(2024, 1, 1), "usd ", Decimal("150.5055")), (date(2024, 1, 1), "USD", Decimal("150.5055")), (None, "USD", None)], "rate_month date, currency string, jpy_per_unit decimal(12,4)")
    data = [(1, 100, "USD", None), (2, 101, "USD cents", None), (3, 7, "万円", None), (4, None, "USD", None), (5, 12, None, None), (6, 3, "JPY", "in millions of yen"), (7, -5, "JPY", None)]
    df = spark.createDataFrame(data, "id int, amount bigint, currency string, remark string").withColumn("unit", F.lit("clash"))
    got = to_yen(df, rates, "amount", "currency", "remark", F.lit(date(2024, 1, 1)), {"id": F.col("id")})
    assert [(a, b, None if c is None else int(c)) for a, b, c in rows(got)] == [(1, "USD", 15051), (2, "USD_CENT", 152), (3, "JPY_10K", 70000), (4, "USD", None), (5, "JPY", 12), (6, "JPY_M", 3000000), (7, "JPY", -5)]
    later = to_yen(df, rates, "amount", "currency", "remark", F.lit(date(2030, 1, 1)), {"id": F.col("id")})
    assert {r.id: r.yen for r in later.collect()}[1] is None
    assert rows(to_yen(df.limit(0), rates.limit(0), "amount", "currency", "remark", F.lit(date(2024, 1, 1)), {"id": F.col("id")})) == []


def test_no_silent_money(spark):
    rates = spark.createDataFrame([(date(2024, 1, 1), "USD", Decimal("150")), (date(2024, 1, 1), "EUR", Decimal("160"))], "rate_month date, currency string, jpy_per_unit decimal(12,4)")
    texts = ["EUR", "HK$", "groats", "k€", "兆円", "千億円", "cents /1000", "百億円", "thousand billion yen", "十億円", "quadrillion", "M¥", "千兆円", "兆兆兆円"]
    df = spark.createDataFrame([(i, 5, t) for i, t in enumerate(texts)], "id int, amount bigint, currency string").withColumn("remark", F.lit(None).cast("string"))
    got = {r.id: (r.unit, None if r.yen is None else int(r.yen)) for r in to_yen(df, rates, "amount", "currency", "remark", F.lit(date(2024, 1, 1)), {"id": F.col("id")}).collect()}
    assert [got[i] for i in range(len(texts))] == [
        ("EUR", 800), ("HKD", None), ("UNKNOWN", None), ("EUR_E3", 800_000), ("JPY_E12", 5 * 10**12), ("JPY_E11", 5 * 10**11), ("USD_E-5", 0), ("JPY_E10", 5 * 10**10), ("JPY_E12", 5 * 10**12), ("JPY_E9", 5 * 10**9), ("UNKNOWN", None), ("JPY_M", 5 * 10**6), ("JPY_E15", 5 * 10**15), ("JPY_E36", None),
    ]
