from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.compare import compare_frames, cross_grain, summary
from tallyforge.plans import catalog
from tallyforge.plans.compiler import Compiler, align, arithmetic
from tallyforge.plans.semantic import Measure, Metric, Registry, Scope, SemanticModel

DATA = [(1, "a", datetime(2024, 1, 5), 10), (2, "a", datetime(2024, 3, 5), 20), (3, None, datetime(2024, 3, 9), None), (4, "b", None, 5)]


@pytest.fixture
def registry():
    build = lambda spark, d: spark.createDataFrame(DATA if d == "full" else [], "id int, g string, at timestamp, x int")
    other = lambda spark, d: spark.createDataFrame([(1, datetime(2024, 2, 1), 0), (2, datetime(2024, 3, 1), 4)], "oid int, day timestamp, y int")
    r = Registry().add(SemanticModel("t", build, ("id",), "t", {"t": "id"}, "at", ("g",)), SemanticModel("o", other, ("oid",), "o", {"o": "oid"}, "day"))
    r.add(Measure("x", "t", "sum", "x"), Measure("one", "t", "sum", "1"), Measure("ids", "t", "count", "x"), Measure("y", "o", "sum", "y"))
    r.add(Metric("sx", "simple", measure="x"), Metric("n", "simple", measure="one"), Metric("c", "simple", measure="ids"), Metric("sy", "simple", measure="y"), Metric("big", "simple", measure="x", where="x > 10"))
    r.add(Metric("per", "ratio", numerator="sx", denominator="sy"), Metric("twice", "derived", expr="v * 2 + 1", inputs=(("v", "sx"),)), Metric("run", "cumulative", base="sx"), Metric("prev", "offset", base="sx", shift=1))
    return r


def test_scopes(registry, spark, rows):
    c = Compiler(registry, spark, "full")
    assert rows(c.query(["sx", "n", "c"], Scope())) == [(35, 4, 3)]
    assert rows(c.query(["sx"], Scope(None, ("g",)))) == [(None, None), ("a", 30), ("b", 5)]
    months = {str(r[0]): tuple(r[1:]) for r in c.query(["sx", "sy", "per", "big"], Scope("month")).collect()}
    assert months == {"None": (5, None, None, None), "2024-01-01": (10, None, None, None), "2024-02-01": (None, 0, None, None), "2024-03-01": (20, 4, 5.0, 20)}
    assert rows(c.query("twice", Scope())) == [(71,)]


def test_empty_input_and_moving_metrics(registry, spark, rows):
    none = Compiler(registry, spark, "none")
    assert rows(none.query(["n", "c"], Scope())) == [(None, 0)]
    assert none.query("run", Scope("month")).count() == 0
    c = Compiler(registry, spark, "full")
    run = {str(r[0]): r[1] for r in c.query("run", Scope("month")).collect()}
    assert run == {"2024-01-01": 10, "2024-02-01": 10, "2024-03-01": 30}
    prev = {str(r[0]): r[1] for r in c.query("prev", Scope("month")).collect()}
    assert prev["2024-03-01"] is None and prev["2024-01-01"] is None  # no February row to take from


def test_moving_metrics_side_by_side(registry, spark, rows):
    """Bases, running totals and shifted ones in one query, by group, over one scan."""
    registry.add(Metric("nrun", "cumulative", base="n"), Metric("last2", "cumulative", base="sx", window=2), Metric("bigrun", "cumulative", base="big"), Metric("share", "derived", expr="r - v", inputs=(("r", "run"), ("v", "sx"))))
    c = Compiler(registry, spark, "full")
    got = {(r.g, str(r.metric_time__month)): tuple(r[2:]) for r in c.query(["sx", "run", "prev", "last2", "bigrun", "share"], Scope("month", ("g",))).collect()}
    assert got == {
        ("a", "2024-01-01"): (10, 10, None, 10, None, 0), ("a", "2024-02-01"): (None, 10, None, 10, None, None), ("a", "2024-03-01"): (20, 30, None, 20, 20, 10),
        (None, "2024-03-01"): (None, None, None, None, None, None), ("b", "None"): (5, None, None, None, None, None),
    }
    assert rows(c.query(["run", "prev", "share"], Scope())) == [(35, 35, 0)]
    plan = c.query(["sx", "run", "prev", "big"], Scope("month"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_repeated_entity_keys_are_an_error(spark):
    r = Registry()
    fact = lambda spark, d: spark.createDataFrame([(1, 7, 10), (2, None, 5)], "id int, k int, x int")
    side = lambda spark, d: spark.createDataFrame([(7, "a"), (None, "n"), (None, "m")] + [(7, "b")] * (d == "twice"), "sid int, name string")
    r.add(SemanticModel("f", fact, ("id",), "f", {"f": "id", "s": "k"}), SemanticModel("s", side, ("sid",), "s", {"s": "sid"}, None, ("name",)), Measure("x", "f", "sum", "x"), Metric("sx", "simple", measure="x"))
    assert sorted(map(tuple, Compiler(r, spark, "once").query("sx", Scope(None, ("s__name",))).collect()), key=str) == [("a", 10), (None, 5)]
    with pytest.raises(Exception, match="does not identify a row"):
        Compiler(r, spark, "twice").query("sx", Scope(None, ("s__name",))).collect()


def test_paths_of_any_length(spark):
    r = Registry()
    for i in range(9):
        r.add(SemanticModel(f"m{i}", None, ("id",), f"e{i}", {f"e{i}": "id", **({f"e{i + 1}": "up"} if i < 8 else {"e0": "up"})}, None, (f"d{i}",)))
    r.add(Measure("x", "m0", "sum", "x"), Metric("sx", "simple", measure="x"))
    assert "__".join([*[f"e{i}" for i in range(1, 9)], "d8"]) in catalog.dimension_paths(r, "sx")


def test_declarations_are_checked(registry):
    with pytest.raises(ValueError):
        Scope("week")
    with pytest.raises(ValueError):
        Scope.parse("by branch")
    assert Scope.parse(" Overall ") == Scope() and Scope.parse("metric_time__month") == Scope("month")
    with pytest.raises(ValueError):
        registry.add(Metric("sx", "simple", measure="x"))
    with pytest.raises(ValueError):
        registry.add(Measure("m", "t", "avg", "x"))
    with pytest.raises(ValueError):
        arithmetic("__import__('os')", {})


def test_compare(spark, rows):
    left = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0), ("d", 1.0)], "k string, x double")
    right = spark.createDataFrame([("a", 1.5), ("b", None), (None, 3.0), ("e", None)], "k string, y double")
    got = {r.k: (r.presence, r.differs) for r in compare_frames(left, right, ["k"], "x", "y").collect()}
    assert got == {None: ("both", False), "a": ("both", True), "b": ("both", False), "d": ("left_only", True), "e": ("right_only", True)}
    back = {r.k: r.differs for r in compare_frames(right, left, ["k"], "y", "x").collect()}
    assert back == {k: v for k, (_, v) in got.items()}  # symmetric
    s = summary(compare_frames(left, right, ["k"], "x", "y", tolerance=1.0), "here").first()
    assert (s.n_groups, s.n_differ, s.agrees_on_sample) == (5, 2, False)
    fine = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    coarse = spark.createDataFrame([("a", 3), ("b", 4)], "k string, w int")
    assert rows(cross_grain(fine, coarse, ["k"], "v", "w"), "k", "differs") == [("a", False), ("b", True)]


def test_align_three_frames_with_null_keys(spark, rows):
    f = lambda data, name: spark.createDataFrame(data, f"k string, {name} int")
    got = align([f([(None, 1)], "a"), f([(None, 2), ("x", 3)], "b"), f([], "c")], ["k"])
    assert rows(got, "k", "a", "b", "c", "in_0", "in_1", "in_2") == [(None, 1, 2, None, True, True, False), ("x", None, 3, None, False, True, False)]


def test_catalog(registry, spark):
    assert catalog.list_metrics(spark, registry).count() == 9
    assert catalog.dimension_paths(registry, "sx") == ["g", "metric_time__day", "metric_time__month", "metric_time__year"]
    assert {r.leaf for r in catalog.trace(spark, registry, "per").collect()} == {"sx", "sy"}
    assert "Aggregate" in catalog.explain(Compiler(registry, spark, "full"), "sx", Scope("month"))
    assert "WHERE (x > 10)" in catalog.render_sql(registry, "big", Scope())
    with pytest.raises(ValueError):
        catalog.inline_sql(spark, "", "drop table x")


def test_sum_of_one_differs_from_count_on_empty_input(spark):
    r = spark.range(0).agg(F.sum(F.lit(1)).alias("s"), F.count("*").alias("n")).first()
    assert (r.s, r.n) == (None, 0)
