"""Keep the row loaded last of all rows with the same key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: dict[str, Column], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """One row per key: the values of the row that is greatest in ``order``.

    ``keys``, ``order`` and ``values`` are expressions over ``df``; the result has exactly the
    named key and value columns, so other columns of ``df`` cannot clash. Ties in ``order`` are
    settled by the greatest values, so equal rows count once and the result never depends on
    row order. A null in ``order`` is the lowest. Null keys form groups of their own. The
    aggregate combines on the map side, so a key that holds a third of all rows is reduced
    before the shuffle.
    """
    best = F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[v.alias(f"v{i}") for i, v in enumerate(values.values())]))
    rows = df.groupBy(*[k.alias(n) for n, k in keys.items()]).agg(best.alias("__best"))
    return rows.select(*keys, *[F.col(f"__best.v{i}").alias(n) for i, n in enumerate(values)])
