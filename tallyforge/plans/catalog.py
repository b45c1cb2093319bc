"""Looking into the metric layer: lists, lineage, plans and SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans.compiler import Compiler
from tallyforge.plans.semantic import Metric, Registry, Scope
from tallyforge.sources.tables import table


def list_metrics(spark: SparkSession, registry: Registry) -> DataFrame:
    """(metric, kind, measure, filter) of every declared metric."""
    rows = [(m.name, m.kind, m.measure, m.where) for m in registry.metrics.values()]
    return spark.createDataFrame(rows, "metric string, kind string, measure string, filter string")


def dimension_paths(registry: Registry, metric: str) -> list[str]:
    """Time grains and dimension paths, of any length, that every model of the metric's measures can reach; no path takes an entity twice."""
    found: list[set[str]] = []
    for leaf in registry.leaves(metric):
        model = registry.models[registry.measures[leaf.measure].model]
        paths = {f"metric_time__{g}" for g in ("day", "month", "year")} if model.time else set()
        todo = [(model, ())]
        while todo:
            at, hops = todo.pop()
            paths |= {"__".join((*hops, x)) for x in at.dimensions}
            todo += [(registry.provider(e), (*hops, e)) for e in at.entities if e != at.primary and e not in hops]
        found.append(paths)
    return sorted(set.intersection(*found)) if found else []


def list_dimensions(spark: SparkSession, registry: Registry, metric: str) -> DataFrame:
    """(dimension) by which a metric can be grouped."""
    return spark.createDataFrame([(p,) for p in dimension_paths(registry, metric)], "dimension string")


def trace(spark: SparkSession, registry: Registry, metric: str) -> DataFrame:
    """Lineage: (metric, leaf, measure, agg, expr, model, grain, time, filter, sql), one row a simple metric it is made of; ``sql`` is the relation of its model."""
    rows = []
    for m in registry.leaves(metric):
        measure = registry.measures[m.measure]
        model = registry.models[measure.model]
        rows.append((metric, m.name, measure.name, measure.agg, measure.expr, model.name, ",".join(model.grain), model.time, m.where, model.sql))
    return spark.createDataFrame(rows, "metric string, leaf string, measure string, agg string, expr string, model string, grain string, time string, filter string, sql string")


def explain(compiler: Compiler, metric: str, scope: Scope) -> str:
    """The formatted plan of a metric instead of its values."""
    df = compiler.query(metric, scope)
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _model_sql(registry: Registry, metrics: list[Metric], scope: Scope, keys: list[str]) -> str:
    """The aggregation of one model's simple metrics, over its entity paths."""
    model = registry.models[registry.measures[metrics[0].measure].model]
    joins, columns, seen = [], {}, {}
    for path in scope.dimensions:
        *hops, column = path.split("__")
        at, alias = model, "b"
        for i, hop in enumerate(hops):
            step = tuple(hops[: i + 1])
            target = registry.provider(hop)
            if step not in seen:
                seen[step] = f"p{len(seen)}"
                joins.append(f" LEFT JOIN {target.sql} AS {seen[step]} ON {alias}.{at.entities[hop]} = {seen[step]}.{target.entities[hop]}")
            at, alias = target, seen[step]
        columns[path] = f"{alias}.{column}"
    if scope.grain:
        columns[keys[0]] = f"CAST(date_trunc('{scope.grain}', b.{model.time}) AS DATE)"
    aggs = []
    for m in metrics:
        measure = registry.measures[m.measure]
        own = f" FILTER (WHERE {m.where})" if m.where else ""
        total = f"{measure.agg}({measure.expr}){own}"
        aggs += [(f"CASE WHEN count(*){own} > 0 THEN {total} END" if own else total) + f" AS {m.name}", f"count(*){own} > 0 AS has_{m.name}"]
    wheres = {m.where for m in metrics}
    where = "" if None in wheres else " WHERE " + " OR ".join(f"({w})" for w in sorted(wheres))
    by = ", ".join(columns[k] for k in keys)
    return f"SELECT {', '.join([f'{columns[k]} AS {k}' for k in keys] + aggs)} FROM {model.sql} AS b{''.join(joins)}{where}" + (f" GROUP BY {by}" if keys else "")


def render_sql(registry: Registry, metric: str, scope: Scope) -> str:
    """SQL text of any metric at a scope, instead of its values: what is aggregated, aligned, moved and combined.

    A common table a model, one that aligns them on null-safe keys, one a moving metric over its
    gapless calendar, and the metric's own arithmetic at the end.
    """
    keys = scope.keys
    models: dict[str, dict[str, Metric]] = {}
    for m in registry.leaves(metric):
        models.setdefault(registry.measures[m.measure].model, {})[m.name] = m
    tables = [f"m{i} AS ({_model_sql(registry, list(ms.values()), scope, keys)})" for i, ms in enumerate(models.values())]
    names = [n for ms in models.values() for n in ms]
    source = "m0"
    for i in range(1, len(models)):
        on = " AND ".join(f"{a} IS NOT DISTINCT FROM m{i}.{k}" for a, k in zip([f"coalesce({', '.join(f'm{j}.{k}' for j in range(i))})" for k in keys], keys)) or "true"
        source += f" FULL JOIN m{i} ON {on}"
    at = [f"coalesce({', '.join(f'm{j}.{k}' for j in range(len(models)))}) AS {k}" for k in keys] if len(models) > 1 else keys
    tables.append(f"base AS (SELECT {', '.join([*at, *names, *[f'has_{n}' for n in names]])} FROM {source})")

    def value(name: str, row: str) -> str:
        m = registry.metrics[name]
        if m.kind == "simple":
            return f"{row}.{name}"
        if m.kind == "ratio":
            return f"(CAST({value(m.numerator, row)} AS DOUBLE) / nullif(CAST({value(m.denominator, row)} AS DOUBLE), 0))"
        if m.kind == "derived":
            return "(" + re.sub(r"[A-Za-z_]\w*", lambda w: value(dict(m.inputs)[w.group()], row) if w.group() in dict(m.inputs) else w.group(), m.expr) + ")"
        return f"{row}.{name}" if scope.grain else value(m.base, row)

    def there(name: str) -> str:
        return "(" + " OR ".join(f"coalesce(has_{m.name}, false)" for m in registry.leaves(name)) + ")"

    moving = registry.moving(metric) if scope.grain else []
    if len(moving) > 1 or (moving and moving[0] != metric):
        raise ValueError(f"{metric}: SQL of a metric over moving ones is not rendered; ask for {moving[0]}")
    if not moving:
        combined = value(metric, "base")
        return f"WITH {', '.join(tables)} SELECT {', '.join([*keys, f'{combined} AS {metric}'])} FROM base"
    m, t, dims = registry.metrics[metric], keys[0], list(scope.dimensions)
    same = "".join(f" AND s.{k} IS NOT DISTINCT FROM v.{k}" for k in dims)
    tables.append(f"own AS (SELECT {', '.join(keys)}, {value(m.base, 'base')} AS v FROM base WHERE {t} IS NOT NULL AND {there(m.base)})")
    if m.kind == "offset":
        return f"WITH {', '.join(tables)} SELECT {', '.join(f's.{k}' for k in keys)}, v.v AS {metric} FROM own s LEFT JOIN own v ON v.{t} = CAST(s.{t} - INTERVAL {m.shift} {scope.grain} AS DATE){same}"
    tables.append(f"spine AS (SELECT {', '.join([f'CAST(unnest(generate_series(min({t}), max({t}), INTERVAL 1 {scope.grain})) AS DATE) AS {t}', *dims])} FROM own" + (f" GROUP BY {', '.join(dims)}" if dims else "") + ")")
    part = f"PARTITION BY {', '.join(f's.{k}' for k in dims)} " if dims else ""
    frame = "UNBOUNDED" if m.window is None else str(m.window - 1)
    return f"WITH {', '.join(tables)} SELECT {', '.join(f's.{k}' for k in keys)}, sum(v.v) OVER ({part}ORDER BY s.{t} ROWS {frame} PRECEDING) AS {metric} FROM spine s LEFT JOIN own v ON s.{t} = v.{t}{same}"


_REF = re.compile(r"\{\{\s*ref\(\s*['\"](\w+)['\"]\s*\)\s*\}\}")


def inline_sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """A read-only query in which ``{{ ref('name') }}`` stands for a table of the folder."""
    if not re.match(r"\s*(select|with)\b", text, re.I):
        raise ValueError("only SELECT is allowed here")
    names = set(_REF.findall(text))
    return spark.sql(_REF.sub(lambda m: "{" + m.group(1) + "}", text), **{n: table(spark, folder, n) for n in names})
