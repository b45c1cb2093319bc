"""Totals and averages over trailing periods, periods without activity included.

Every period's total is exploded onto the output periods it influences (itself and the
``longest - 1`` after it), the contributions are added up by entity and period, and the rows
of the entity's calendar join in so that silent periods come out with zeros. Calendar rows are
contributions of zero to the same grouping: that equals an outer join of calendar and totals,
but reads the input once and shuffles nothing more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_totals(periods: DataFrame, entity: str, period: str, measures: list[str], windows: list[int], rows: str | None = None) -> DataFrame:
    """Trailing totals and averages of every entity for every period from its first to its last.

    ``periods`` holds integer period numbers (days or months counted from any origin) and may
    hold several rows an entity and period: they are added up first, on the map side where
    possible, so a hot entity shrinks to its periods before anything is exploded. Returns
    (entity, period, first_period, n_rows, and for each measure m and window w
    ``m_total_w`` and ``m_avg_w``). A null measure adds nothing; a window without rows totals 0.
    The average divides by the periods of the window that are not before the entity's first.
    Rows with a null entity or period take part nowhere. An empty table gives no rows; ``n_rows``
    counts input rows of the period itself, 0 for a silent one. ``rows`` names a column that
    holds counts of rows already added up.
    """
    longest = max(windows)
    src = periods.select(F.col(entity).alias("entity"), F.col(period).cast("int").alias("period"), (F.col(rows) if rows else F.lit(1)).cast("bigint").alias("n_rows"), *[F.col(m).alias(f"m_{i}") for i, m in enumerate(measures)])
    src = src.where(F.col("entity").isNotNull() & F.col("period").isNotNull())
    kinds = [src.schema[f"m_{i}"].dataType.simpleString() for i in range(len(measures))]
    own = src.groupBy("entity", "period").agg(F.sum("n_rows").alias("n_rows"), *[F.coalesce(F.sum(f"m_{i}"), F.lit(0)).alias(f"m_{i}") for i in range(len(measures))])
    span = Window.partitionBy("entity")  # a row a period, however many rows the entity has
    own = own.withColumns({"first_period": F.min("period").over(span), "last_period": F.max("period").over(span)})

    # onto the periods it influences, and from an entity's first row onto its whole calendar (no distance: adds nothing)
    to = lambda period, ahead: F.struct(period.alias("to"), ahead.cast("int").alias("ahead"))
    influenced = F.transform(F.sequence(F.lit(0), F.least(F.lit(longest - 1), F.col("last_period") - F.col("period"))), lambda a: to(F.col("period") + a, a))
    calendar = F.transform(F.sequence("first_period", "last_period"), lambda p: to(p, F.lit(None)))
    reach = own.withColumn("t", F.explode(F.when(F.col("period") == F.col("first_period"), F.concat(influenced, calendar)).otherwise(influenced)))
    ahead = F.col("t.ahead")
    out = reach.groupBy("entity", "first_period", F.col("t.to").alias("period")).agg(
        F.sum(F.when(ahead == 0, F.col("n_rows")).otherwise(0)).alias("n_rows"),
        *[F.sum(F.when(ahead < w, F.col(f"m_{i}")).otherwise(0)).alias(f"t_{i}_{w}") for i in range(len(measures)) for w in windows],
    )
    cols = [F.col("entity").alias(entity), F.col("period").alias(period), F.col("first_period"), F.col("n_rows").cast("bigint").alias("n_rows")]
    for i, m in enumerate(measures):
        for w in windows:
            total = F.col(f"t_{i}_{w}")
            held = F.least(F.lit(w), F.col("period") - F.col("first_period") + 1)
            total = total.cast("bigint") if kinds[i] in ("bigint", "int") else total
            cols += [total.alias(f"{m}_total_{w}"), (total.cast("double") / held).alias(f"{m}_avg_{w}")]
    return out.select(*cols)


def borne_out(totals: DataFrame, entity: str, period: str, measures: list[str], windows: list[int]) -> DataFrame:
    """The same rows, each checked: the trailing totals of the measures must agree with each other, else it is an error.

    The total over one period is its own contribution; over a gapless calendar the last ``w`` of
    them add up to the total over ``w``. ``windows`` has 1 in it. A window over the entity's
    periods, which lie together already.
    """
    along = Window.partitionBy(entity).orderBy(period)
    right = [F.sum(f"{m}_total_1").over(along.rowsBetween(1 - w, 0)) == F.col(f"{m}_total_{w}") for m in measures for w in windows if w > 1]
    checked = totals.select("*", reduce(Column.__and__, right).alias("__right"))
    return checked.where(F.assert_true("__right", F.lit("trailing totals do not add up")).isNull()).drop("__right")
