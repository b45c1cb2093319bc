import random

from pyspark.sql import functions as F

from tallyforge.operators.late import classify_arrivals, revision_triangle
from tallyforge.operators.orphans import add_deltas, current_orphans, existence_deltas, orphan_instants, record_series, reference_deltas, signed_counts

SCHEMA = "record string, event_no int, arrival_no int, arrival int, loaded int, amount bigint"


def test_outcomes_and_revisions(spark, rows):
    data = [
        ("a", 1, 2, 20, 1, 10), ("a", 1, 2, 20, 0, 77), ("a", 1, 2, 20, 1, 10), ("a", 1, 3, 30, None, 15), ("a", 1, 5, 50, 1, 99),  # restated, then beyond the cut-off
        ("b", 1, 3, 30, 1, 7),  # late; gone from the third delivery
        ("c", 1, 2, 20, 1, 1), ("c", 1, 4, 40, 1, 2),  # away once, then back
        ("d", 1, 5, 50, 1, 5), ("e", 1, 4, 40, 1, None), (None, 1, 2, 20, 1, 1), ("f", None, 2, 20, 1, 1),
    ]
    seen = classify_arrivals(spark.createDataFrame(data, SCHEMA), on_time=1, cutoff=3)
    assert rows(seen, "record", "lag", "outcome") == [("a", 1, "on_time"), ("a", 2, "restated"), ("a", 4, "rejected"), ("b", 2, "accepted"), ("c", 1, "on_time"), ("c", 3, "restated"), ("d", 4, "rejected"), ("e", 3, "accepted")]
    assert rows(seen.where("record = 'a'"), "lag", "delta", "revised") == [(1, 10, 10), (2, 5, 15), (4, 84, 15)]  # what came too late leaves the total untouched
    full = revision_triangle(seen, cutoff=3, full_deliveries=True)
    assert rows(full, "lag", "n_new", "n_restated", "n_returned", "n_withdrawn", "delta", "total") == [(1, 2, 0, 0, 0, 11, 11), (2, 1, 1, 0, 1, 11, 22), (3, 1, 0, 1, 2, -20, 2)]
    kept = revision_triangle(seen, cutoff=3, full_deliveries=False)
    assert rows(kept, "lag", "total") == [(1, 11), (2, 23), (3, 24)]
    empty = classify_arrivals(spark.createDataFrame([], SCHEMA), 1, 3)
    assert empty.count() == 0 and revision_triangle(empty, 3, True).count() == 0


def test_full_deliveries_end_in_each_delivery_s_total(spark):
    r = random.Random(2)
    data = list({(k, lag): (k, 1, 1 + lag, 10 * lag, 1, r.randint(0, 9)) for k in "abcdefgh" for lag in (1, 2, 3) if r.random() < 0.6}.values())
    got = {x.lag: x.total for x in revision_triangle(classify_arrivals(spark.createDataFrame(data, SCHEMA), 1, 3), 3, True).collect()}
    assert got == {lag: sum(x[5] for x in data if x[2] == lag + 1) for lag in got}


def test_orphans(spark, rows):
    versions = spark.createDataFrame([("a", 5, 8), ("a", 10, None), ("b", 20, 30), (None, 1, 2)], "k string, lo int, hi int")
    refs = spark.createDataFrame([("a", 1, 4), ("a", 2, 5), ("a", 3, 8), ("a", 4, 8), ("a", 4, 8), ("a", 5, 10), ("b", 1, 1), ("b", 2, 30), ("x", None, 3), (None, 1, 3), ("a", 1, None)], "k string, r int, at int")
    deltas = reference_deltas(record_series(refs, "k", ["r"], "at"))
    exist = existence_deltas(versions, "k", "lo", "hi")
    assert rows(orphan_instants(deltas, exist)) == [("a", 4, 1, 1, "later"), ("a", 8, 2, 4, "gone"), ("b", 1, 1, 1, "later"), ("b", 30, 1, 2, "gone"), ("x", 3, 1, 1, "missing")]
    assert orphan_instants(deltas.limit(0), exist).count() == 0
    assert {r.reason for r in orphan_instants(deltas, exist.limit(0)).collect()} == {"missing"}
    assert rows(current_orphans(add_deltas(None, deltas, exist))) == [("b", 2, "gone"), ("x", 1, "missing")]


def test_references_are_taken_back(spark, rows):
    """Records come, are left out of the delivery due, and come back: the counts follow, at once or bit by bit."""
    r = random.Random(4)
    days = list(range(1, 9))
    came = {(k, n): sorted(r.sample(days, r.randint(1, 6))) for k in "abc" for n in range(6)}
    due = lambda n, t: t + 1 if t < 8 and (t + n) % 3 else None
    data = [(k, n, t, due(n, t)) for (k, n), ts in came.items() for t in ts]
    df = spark.createDataFrame([*data, *data[:5], (None, 1, 1, None)], "k string, n int, at int, due int").withColumn("key", F.lit("clash"))
    deltas = reference_deltas(record_series(df, "k", ["n"], "at", "due"))

    def alive(k, upto):
        out = 0
        for (key, n), ts in came.items():
            seen = [t for t in ts if t <= upto]
            if key == k and seen:
                out += due(n, seen[-1]) is None or due(n, seen[-1]) > upto
        return out

    none = spark.createDataFrame([], "key string, at int, delta int")
    counts = {(x.key, x.at): x.references for x in signed_counts(deltas, none).collect()}
    assert counts and all(n == alive(*k) for k, n in counts.items())
    whole = rows(add_deltas(None, deltas, none))
    assert [x[:2] for x in whole] == [(k, alive(k, 9)) for k in "abc"]
    steps = None
    for t in range(1, 10):
        steps = add_deltas(steps, deltas.where(F.col("at") == t), none)
    assert rows(steps) == whole
