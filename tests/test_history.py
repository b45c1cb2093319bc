import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.asof import as_known
from tallyforge.operators.history import build_history, merge_snapshot

SCHEMA = "k string, day date, plan string, status string, loaded timestamp"


def history(df):
    return build_history(df, F.col("k"), F.col("day"), {"plan": F.col("plan"), "status": F.col("status")}, F.col("loaded"), carry=("plan",))


def brute(data):
    """Key by key, snapshot by snapshot."""
    data = [r for r in data if r[0] is not None and r[1] is not None]
    days = sorted({r[1] for r in data})
    out = []
    for k in {r[0] for r in data}:
        open_ = None
        for i, d in enumerate(days):
            mine = [r for r in data if r[:2] == (k, d)]
            if not mine:
                if open_:
                    out.append((k, *open_, d))
                    open_ = None
                continue
            key = lambda r: tuple((x is not None, x) for x in (r[4], r[2], r[3]))
            _, _, plan, status, _ = max(mine, key=key)
            plan = plan if plan is not None else open_[0] if open_ else None
            if open_ and (plan, status) == open_[:2]:
                continue
            if open_:
                out.append((k, *open_, d))
            open_ = (plan, status, d)
        if open_:
            out.append((k, *open_, date(9999, 12, 31)))
    return sorted(out, key=str)


def sample(seed, n=160):
    r = random.Random(seed)
    days = [date(2024, 1, 1) + timedelta(days=30 * i) for i in range(6)]
    return [(r.choice(["a", "b", "c", "d", None]), r.choice([*days, None]), r.choice(["x", "y", None]), r.choice(["on", "off", None]), datetime(2024, 1, r.randint(1, 5))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("n", [0, 12, 60])
def test_history_against_brute_force(spark, seed, n):
    data = sample(seed, n)
    df = spark.createDataFrame(data, SCHEMA).withColumn("snap_no", F.lit("clash")).withColumn("key", F.lit(1))
    got = sorted(((r.key, r.plan, r.status, r.valid_from, r.valid_to) for r in history(df).collect()), key=str)
    assert got == brute(data)


def test_merge_step_by_step_equals_the_fold(spark, rows):
    data = [x for x in {(r[0], r[1]): r for r in sample(7) if r[0] and r[1]}.values()]
    df = spark.createDataFrame(data, SCHEMA)
    steps = spark.createDataFrame([], "key string, plan string, status string, valid_from date, valid_to date, hash bigint")
    for d in sorted({r[1] for r in data}):
        steps = merge_snapshot(steps, df.where(F.col("day") == d).select(F.col("k").alias("key"), "plan", "status"), F.lit(d), ["plan", "status"], ("plan",))
    cols = ["key", "plan", "status", "valid_from", "valid_to"]
    assert rows(steps, *cols) == rows(history(df), *cols)
    newest = history(df).where("newest").groupBy("key").count().where("count > 1")
    assert newest.count() == 0


def test_as_known(spark, rows, monkeypatch):
    import tallyforge.operators.asof as asof

    r = random.Random(3)
    day = lambda n: date(2024, 1, 1) + timedelta(days=n)
    versions = [(r.choice(["a", "b", "c", None]), day(r.randint(0, 50)), r.choice([None, day(60), day(90)]), day(r.randint(0, 80)), f"v{i}") for i in range(40)]
    # starts of one entity are distinct, so that the answer is
    versions = list({(v[0], v[1]): v for v in versions}.values())
    events = [(r.choice(["a", "a", "a", "b", "zz", None]), r.choice([None, day(r.randint(0, 100))]), i, "clash") for i in range(200)]
    want = []
    for k, at, i, _ in events:
        seen = [v for v in versions if at and k and v[0] == k and max(v[1], v[3]) <= at]
        best = max(seen, key=lambda v: v[1], default=None)
        if best and best[2] and at >= best[2]:
            best = None
        want.append((i, best[4] if best else None, best[1] if best else None))
    monkeypatch.setattr(asof, "EVENTS_PER_SALT", 10)  # the hot entity is spread
    ev = spark.createDataFrame(events, "k string, at date, i int, attr string")
    ve = spark.createDataFrame(versions, "k string, start date, stop date, recorded date, attr string")
    got = as_known(ev, ve, "k", "at", "start", ["attr"], valid_to="stop", recorded="recorded", keep=["i", "attr"])
    assert rows(got.select("i", "attr_then", "known_from")) == sorted(want)
    none = as_known(ev, ve.limit(0), "k", "at", "start", ["attr"], keep=["i"])
    assert none.where("attr is not null").count() == 0 and none.count() == 200
    assert as_known(ev.limit(0), ve, "k", "at", "start", ["attr"]).count() == 0
