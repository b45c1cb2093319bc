"""Building a project: seeds, models, snapshots and tests in the order of what they need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("seed", "model", "snapshot", "test")


@dataclass(frozen=True)
class Node:
    """One step: ``make`` gets the session and the frames it needs, by name, and gives a frame.

    The frame of a test holds the rows that break its rule.
    """

    name: str
    kind: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]


def unique(of: str, key: list[str]) -> Callable[..., DataFrame]:
    """Keys that occur more than once."""
    return lambda spark, **at: at[of].groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def not_null(of: str, column: str) -> Callable[..., DataFrame]:
    return lambda spark, **at: at[of].where(F.col(column).isNull())


def accepted(of: str, column: str, values: tuple[str, ...]) -> Callable[..., DataFrame]:
    """Values that are none of ``values``; null is no value."""
    return lambda spark, **at: at[of].where(~F.col(column).isin(*values)).select(column).distinct()


def related(of: str, column: str, to: str, key: str) -> Callable[..., DataFrame]:
    """Values of a column that the other frame's key does not have."""
    return lambda spark, **at: at[of].where(F.col(column).isNotNull()).join(at[to], at[of][column] == at[to][key], "left_anti").select(column).distinct()


def build(spark: SparkSession, nodes: list[Node]) -> dict[str, DataFrame]:
    """Every frame by name, made after all it needs; a circle or an unknown name is an error. Lazy: nothing runs yet."""
    by_name = {n.name: n for n in nodes}
    for n in nodes:
        if n.kind not in KINDS or (missing := set(n.needs) - set(by_name)):
            raise ValueError(f"{n.name}: kind {n.kind!r}, unknown needs {sorted(missing) if n.kind in KINDS else ''}")
    done: dict[str, DataFrame] = {}
    for name in TopologicalSorter({n.name: n.needs for n in nodes}).static_order():
        done[name] = by_name[name].make(spark, **{x: done[x] for x in by_name[name].needs})
    return done


def report(nodes: list[Node], done: dict[str, DataFrame]) -> DataFrame:
    """(node, kind, n_rows, status), one row a node; a test passes if it holds no rows."""
    rows = [done[n.name].agg(F.lit(n.name).alias("node"), F.lit(n.kind).alias("kind"), F.count("*").alias("n_rows")) for n in nodes]
    status = F.when(F.col("kind") != "test", "built").when(F.col("n_rows") == 0, "pass").otherwise("fail")
    return reduce(DataFrame.unionByName, rows).withColumn("status", status)
