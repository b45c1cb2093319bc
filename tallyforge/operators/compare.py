"""Evidence on a pair of metrics at one declared scope: values, differences, missing groups. No verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.plans.compiler import Compiler, align
from tallyforge.plans.semantic import Scope


def compare_frames(left: DataFrame, right: DataFrame, keys: list[str], v1: str, v2: str, tolerance: float = 0.0) -> DataFrame:
    """(*keys, v1, v2, delta, presence, differs) of two aggregates over the same keys.

    ``presence`` tells a group missing on one side (`left_only`, `right_only`) from one whose value
    is null; ``differs`` is null-safe: null against a value differs, null against null does not.
    """
    both = align([left.select(*keys, F.col(v1).cast("double").alias("v1")), right.select(*keys, F.col(v2).cast("double").alias("v2"))], keys)
    presence = F.when(F.col("in_0") & F.col("in_1"), "both").when(F.col("in_0"), "left_only").otherwise("right_only")
    differs = F.when(F.col("v1").isNull() | F.col("v2").isNull(), ~F.col("v1").eqNullSafe(F.col("v2"))).otherwise(F.abs(F.col("v1") - F.col("v2")) > F.lit(tolerance))
    return both.select(*keys, "v1", "v2", (F.col("v1") - F.col("v2")).alias("delta"), presence.alias("presence"), (differs | (presence != "both")).alias("differs"))


def compare(compiler: Compiler, m1: str, m2: str, scope: Scope, tolerance: float = 0.0) -> DataFrame:
    """Both metrics at the one given scope, compared group by group; both sides share the scope object."""
    return compare_frames(compiler.query(m1, scope), compiler.query(m2, scope), scope.keys, m1, m2, tolerance)


def summary(report: DataFrame, scope: str) -> DataFrame:
    """(scope, n_groups, n_differ, n_left_only, n_right_only, agrees_on_sample): agreement on these data proves nothing more."""
    return report.agg(
        F.lit(scope).alias("scope"),
        F.count("*").alias("n_groups"),
        F.count_if("differs").alias("n_differ"),
        F.count_if(F.col("presence") == "left_only").alias("n_left_only"),
        F.count_if(F.col("presence") == "right_only").alias("n_right_only"),
        (F.count_if("differs") == 0).alias("agrees_on_sample"),
    )


def compare_scopes(compiler: Compiler, m1: str, m2: str, scopes: list[str], tolerance: float = 0.0) -> DataFrame:
    """One summary a declared scope, so that a pair equal at some scopes only shows where it parts."""
    return reduce(DataFrame.unionByName, [summary(compare(compiler, m1, m2, Scope.parse(s), tolerance), s) for s in scopes])


def cross_grain(fine: DataFrame, coarse: DataFrame, keys: list[str], fine_value: str, coarse_value: str, tolerance: float = 0.0) -> DataFrame:
    """Whether a finer aggregate rolls up to a coarser one: re-aggregated to the keys, then compared."""
    return compare_frames(fine.groupBy(*keys).agg(F.sum(fine_value).alias("fine")), coarse, keys, "fine", coarse_value, tolerance)
