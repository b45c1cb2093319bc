import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.rolling import borne_out, trailing_totals


def test_against_brute_force(spark, rows):
    r = random.Random(5)
    data = [(r.choice(["a", "b", None]), r.choice([None, r.randint(1, 30)]), r.choice([None, r.randint(-5, 50)])) for _ in range(60)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in data], "e string, p int, m bigint, n_rows string, entity int")
    got = {(x.e, x.p): x for x in trailing_totals(df, "e", "p", ["m"], [3, 7]).collect()}
    clean = [x for x in data if x[0] is not None and x[1] is not None]
    want = 0
    for e in {x[0] for x in clean}:
        ps = [x[1] for x in clean if x[0] == e]
        for p in range(min(ps), max(ps) + 1):
            want += 1
            row = got[e, p]
            assert row.n_rows == ps.count(p)
            for w in (3, 7):
                total = sum(x[2] or 0 for x in clean if x[0] == e and p - w < x[1] <= p)
                assert row[f"m_total_{w}"] == total
                assert abs(row[f"m_avg_{w}"] - total / min(w, p - min(ps) + 1)) < 1e-9
    assert len(got) == want
    assert trailing_totals(df.limit(0), "e", "p", ["m"], [3]).count() == 0


def test_totals_are_borne_out(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 4, 7), ("a", 9, None), ("b", 2, 1)], "e string, p int, m bigint")
    out = trailing_totals(df, "e", "p", ["m"], [1, 3, 7])
    assert borne_out(out, "e", "p", ["m"], [1, 3, 7]).count() == out.count() == 10
    wrong = out.withColumn("m_total_3", F.col("m_total_3") + (F.col("p") == 6).cast("int"))
    with pytest.raises(Exception, match="do not add up"):
        borne_out(wrong, "e", "p", ["m"], [1, 3, 7]).collect()
