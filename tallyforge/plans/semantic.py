"""Declarations of the metric layer: semantic models, measures, metrics, scopes and their registry."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

GRAINS = ("day", "month", "year")
KINDS = ("simple", "ratio", "derived", "cumulative", "offset")


@dataclass(frozen=True)
class SemanticModel:
    """A relation with a grain: ``build`` gives its rows, ``grain`` the columns unique in them.

    ``entities`` maps an entity to its key column here; the ``primary`` one identifies a row, the
    others lead to the model of which they are primary. ``time`` is the default time column and
    ``sql`` the same relation as SQL text.
    """

    name: str
    build: Callable[[SparkSession, str], DataFrame]
    grain: tuple[str, ...]
    primary: str
    entities: dict[str, str] = field(default_factory=dict)
    time: str | None = None
    dimensions: tuple[str, ...] = ()
    sql: str = ""


@dataclass(frozen=True)
class Measure:
    """``agg`` (sum or count) of an SQL expression over the rows of a model."""

    name: str
    model: str
    agg: str
    expr: str


@dataclass(frozen=True)
class Metric:
    """A named number.

    simple: ``measure``; ratio: ``numerator`` over ``denominator`` (metrics, aggregated apart);
    derived: ``expr`` over the aliases in ``inputs``; cumulative: running total of ``base`` or of
    its last ``window`` periods; offset: ``base`` moved by ``shift`` periods. ``where`` filters the
    rows of simple metrics.
    """

    name: str
    kind: str
    measure: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    expr: str | None = None
    inputs: tuple[tuple[str, str], ...] = ()
    base: str | None = None
    window: int | None = None
    shift: int = 0
    where: str | None = None


@dataclass(frozen=True)
class Scope:
    """What a metric is grouped by: nothing, a time grain, dimension paths (`customer__nation__n_name`), or both."""

    grain: str | None = None
    dimensions: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.grain is not None and self.grain not in GRAINS:
            raise ValueError(f"grain must be one of {GRAINS} or None, not {self.grain!r}")

    @property
    def keys(self) -> list[str]:
        return ([f"metric_time__{self.grain}"] if self.grain else []) + list(self.dimensions)

    @staticmethod
    def parse(text: str) -> Scope:
        """`ungrouped total`, `overall` or `metric_time__<grain>`; anything else is no declared scope."""
        t = " ".join(unicodedata.normalize("NFKC", text).lower().split())
        if t in ("ungrouped total", "overall", "overall total"):
            return Scope()
        if t.startswith("metric_time__"):
            return Scope(t.removeprefix("metric_time__"))
        raise ValueError(f"not a declared scope: {text!r}")


@dataclass
class Registry:
    models: dict[str, SemanticModel] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)

    def add(self, *things: SemanticModel | Measure | Metric) -> Registry:
        for t in things:
            kind = {SemanticModel: self.models, Measure: self.measures, Metric: self.metrics}[type(t)]
            if t.name in kind:
                raise ValueError(f"{t.name} is declared twice")
            if isinstance(t, Measure) and (t.agg not in ("sum", "count") or t.model not in self.models):
                raise ValueError(f"measure {t.name}: aggregation or model unknown")
            if isinstance(t, Metric) and t.kind not in KINDS:
                raise ValueError(f"metric {t.name}: kind {t.kind!r} unknown")
            kind[t.name] = t
        return self

    def parts(self, metric: str) -> list[str]:
        """The metrics that a metric is directly made of."""
        m = self.metrics[metric]
        return {"simple": [], "ratio": [m.numerator, m.denominator], "derived": [b for _, b in m.inputs]}.get(m.kind, [m.base])

    def leaves(self, metric: str) -> list[Metric]:
        """The simple metrics that a metric is made of, in order."""
        m = self.metrics[metric]
        return [m] if m.kind == "simple" else list({x.name: x for b in self.parts(metric) for x in self.leaves(b)}.values())

    def moving(self, metric: str) -> list[str]:
        """The cumulative and shifted metrics that a metric is or is made of, those first that others build on."""
        own = [metric] if self.metrics[metric].kind in ("cumulative", "offset") else []
        return list(dict.fromkeys([x for b in self.parts(metric) for x in self.moving(b)] + own))

    def provider(self, entity: str) -> SemanticModel:
        """The model in which an entity identifies a row."""
        return next(m for m in self.models.values() if m.primary == entity)
