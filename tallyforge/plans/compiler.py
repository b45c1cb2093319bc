"""Metrics to DataFrames: every leaf aggregated at the scope first, then joined and combined."""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.plans.semantic import Metric, Registry, Scope, SemanticModel


def align(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer alignment of aggregates on null-safe keys, with ``in_<i>`` telling which frames had the group.

    Frames have one row a key at most and no value column in common. One grouping of their union
    replaces a chain of full joins: a null key meets a null key, and all frames move in one shuffle.
    """
    values = {c: f.schema[c].dataType for f in frames for c in f.columns if c not in keys}
    parts = []
    for i, f in enumerate(frames):
        marks = [F.lit(True if i == j else None).cast("boolean").alias(f"in_{j}") for j in range(len(frames))]
        parts.append(f.select(*keys, *[(F.col(c) if c in f.columns else F.lit(None)).cast(t).alias(c) for c, t in values.items()], *marks))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    present = [F.coalesce(F.max(f"in_{j}"), F.lit(False)).alias(f"in_{j}") for j in range(len(frames))]
    return out.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values], *present)


def time_key(time: str, grain: str) -> Column:
    return F.date_trunc(grain, F.col(time)).cast("date").alias(f"metric_time__{grain}")


class Compiler:
    """Compiles metrics of a registry over the tables of a folder."""

    def __init__(self, registry: Registry, spark: SparkSession, folder: str) -> None:
        self.registry, self.spark, self.folder = registry, spark, folder

    def rows(self, model: SemanticModel) -> DataFrame:
        return model.build(self.spark, self.folder)

    def _one_each(self, side: DataFrame, key: str, model: SemanticModel) -> DataFrame:
        """``side``, asserted to hold its key once: a repeated one would double sums without a word.

        The count needs the rows of a key together, as the join does unless the side is small.
        Rows without a key, which nothing joins, are left out.
        """
        counted = side.where(F.col(key).isNotNull()).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
        return counted.where(F.assert_true(F.col("__n") == 1, F.lit(f"{model.name}: {model.primary} does not identify a row")).isNull()).drop("__n")

    def _with_paths(self, df: DataFrame, model: SemanticModel, paths: tuple[str, ...]) -> DataFrame:
        """Dimension columns reached over entities, by left joins N:1 from the model's side.

        The provider of an entity must have its key unique (:meth:`_one_each`), so no row is
        repeated; a prefix shared by paths is joined once.
        """
        done: dict[str, tuple[DataFrame, SemanticModel, str]] = {}
        for path in paths:
            *hops, column = path.split("__")
            at, here, prefix = model, "", ""
            for hop in hops:
                step = f"{prefix}{hop}__"
                if step not in done:
                    target = self.registry.provider(hop)
                    side = self._one_each(self.rows(target), target.entities[hop], target)
                    side = side.select(*[F.col(c).alias(f"{step}{c}") for c in side.columns])
                    df = df.join(side, df[f"{here}{at.entities[hop]}"] == side[f"{step}{target.entities[hop]}"], "left")
                    done[step] = (side, target, step)
                at, here, prefix = done[step][1], step, step
        return df

    def leaf(self, metrics: list[Metric], scope: Scope) -> DataFrame:
        """Simple metrics of one model in one aggregation over one scan, with ``has_<metric>`` telling which have rows in a group.

        A filter that all of them share goes to the scan, others become conditions of their
        aggregates; rows that no metric wants are left out first.
        """
        model = self.registry.models[self.registry.measures[metrics[0].measure].model]
        wheres = {m.where for m in metrics}
        df = self.rows(model)
        if None not in wheres:
            df = df.where(" OR ".join(f"({w})" for w in sorted(wheres)))
        df = self._with_paths(df, model, scope.dimensions)
        keys = ([time_key(model.time, scope.grain)] if scope.grain else []) + [F.col(d) for d in scope.dimensions]
        aggs = []
        for m in metrics:
            measure = self.registry.measures[m.measure]
            own = F.expr(m.where) if len(wheres) > 1 and m.where else None
            x = F.expr(measure.expr) if own is None else F.when(own, F.expr(measure.expr))
            total = F.count(x) if measure.agg == "count" else F.sum(x)
            has = F.lit(True) if own is None else F.count_if(own) > 0
            aggs += [(total if own is None else F.when(has, total)).alias(m.name), has.alias(f"has_{m.name}")]
        return df.groupBy(*keys).agg(*aggs)

    def query(self, names: list[str] | str, scope: Scope) -> DataFrame:
        """One row a group of the scope with a column a metric; groups and values as the data have them, nulls kept.

        Every model is scanned and aggregated once, whatever the metrics made of it: bases of moving
        metrics, numerators and filtered ones share the pass. What moves over time is then worked
        out by windows over the aggregated periods.
        """
        names = [names] if isinstance(names, str) else list(names)
        models: dict[str, dict[str, Metric]] = {}
        for n in names:
            for m in self.registry.leaves(n):
                models.setdefault(self.registry.measures[m.measure].model, {})[m.name] = m
        frames = [self.leaf(list(ms.values()), scope) for ms in models.values()]
        df = frames[0] if len(frames) == 1 else align(frames, scope.keys)
        moving = list(dict.fromkeys(x for n in names for x in self.registry.moving(n)))
        if moving and scope.grain:
            df, stands = self._move(df, moving, scope)
            df = df.where(reduce(Column.__or__, [self._stands(n, stands) for n in names]))
        return df.select(*scope.keys, *[self._value(n, scope).alias(n) for n in names])

    def _stands(self, name: str, moving: dict[str, Column]) -> Column:
        """Whether a metric has a value's place in a group: where any of its parts has rows, or ``moving`` says so."""
        m = self.registry.metrics[name]
        if name in moving:
            return moving[name]
        if m.kind == "simple":
            return F.coalesce(F.col(f"has_{name}"), F.lit(False))
        return reduce(Column.__or__, [self._stands(b, moving) for b in self.registry.parts(name)])

    def _move(self, df: DataFrame, moving: list[str], scope: Scope) -> tuple[DataFrame, dict[str, Column]]:
        """The frame over a gapless calendar with a column for each moving metric, and the rows in which each stands.

        A cumulative metric stands from the first to the last period of its base, a shifted one where
        its base has rows; without the period it was shifted from it is null.
        """
        t = f"metric_time__{scope.grain}"
        df = self.spine(df, scope, keep_undated=True)
        group = Window.partitionBy(*scope.dimensions)  # a row a period, aggregated before
        order = group.orderBy(t)
        dated = F.col(t).isNotNull()
        stands: dict[str, Column] = {}
        for n in moving:
            m = self.registry.metrics[n]
            has = self._stands(m.base, stands)
            value = F.when(dated, self._value(m.base, scope))
            if m.kind == "offset":
                df, stands[n] = df.withColumn(n, F.when(has, F.lag(value, m.shift).over(order))), has & dated
                continue
            frame = order.rowsBetween(Window.unboundedPreceding if m.window is None else 1 - m.window, 0)
            ends = [f(F.when(has & dated, F.col(t))).over(group).alias(f"{n}_{e}") for f, e in ((F.min, "lo"), (F.max, "hi"))]
            df = df.select("*", F.sum(value).over(frame).alias(f"{n}_sum"), *ends)
            stands[n] = F.coalesce(F.col(t).between(F.col(f"{n}_lo"), F.col(f"{n}_hi")), F.lit(False))
            df = df.withColumn(n, F.when(stands[n], F.col(f"{n}_sum")))
        return df, stands

    def _value(self, name: str, scope: Scope) -> Column:
        m = self.registry.metrics[name]
        if m.kind == "simple":
            return F.col(name)
        if m.kind == "ratio":  # of the two totals, never a mean of row ratios
            return self._value(m.numerator, scope).cast("double") / F.nullif(self._value(m.denominator, scope).cast("double"), F.lit(0.0))
        if m.kind == "derived":
            return arithmetic(m.expr, {a: self._value(b, scope) for a, b in m.inputs})
        # without a time nothing moves: a running total is the total
        return F.col(name) if scope.grain else self._value(m.base, scope)

    def spine(self, df: DataFrame, scope: Scope, keep_undated: bool = False) -> DataFrame:
        """Every period from the first to the last of each dimension group; values of missing ones stay null.

        ``df`` has a row a period and group. Each row is repeated, emptied, over the gap up to the
        next one, so the frame is passed over once; undated rows are left out unless ``keep_undated``.
        """
        t = f"metric_time__{scope.grain}"
        step = F.expr(f"interval 1 {scope.grain}")
        gap_end = F.coalesce((F.lead(t).over(Window.partitionBy(*scope.dimensions).orderBy(t)) - step).cast("date"), F.col(t))
        days = F.when(F.col(t).isNotNull(), F.sequence(t, F.greatest(gap_end, F.col(t)), step))
        days = F.coalesce(days, F.array(F.lit(None).cast("date"))) if keep_undated else days
        rest = [c for c in df.columns if c not in scope.keys]
        wide = df.withColumn("__days", days).select(*scope.dimensions, F.col(t).alias("__own"), F.explode("__days").alias(t), *rest)
        return wide.select(*scope.keys, *[F.when(F.col("__own").eqNullSafe(F.col(t)), F.col(c)).alias(c) for c in rest])


def arithmetic(expr: str, values: dict[str, Column]) -> Column:
    """Arithmetic (+ - * /), nullif and numbers over columns; a division by zero is a null, never an error."""
    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Name):
            return values[node.id]
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(node.value)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -walk(node.operand)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "nullif" and len(node.args) == 2:
            return F.nullif(walk(node.args[0]), walk(node.args[1]))
        if isinstance(node, ast.BinOp):
            a, b = walk(node.left), walk(node.right)
            if isinstance(node.op, ast.Add):
                return a + b
            if isinstance(node.op, ast.Sub):
                return a - b
            if isinstance(node.op, ast.Mult):
                return a * b
            if isinstance(node.op, ast.Div):
                return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
        raise ValueError(f"not an arithmetic expression: {expr!r}")

    return walk(ast.parse(expr, mode="eval"))
