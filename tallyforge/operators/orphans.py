"""References to records that do not exist, from signed counts per key and instant.

Both sides come as change deltas. A referring record adds 1 to the reference count of its key
when a delivery first brings it and takes 1 back when the next delivery that should repeat it
leaves it out; a version of the record referred to adds 1 to the existence count when it begins
and takes 1 when it ends. Deltas are added up by (key, time) on the map side, so a hot key
shrinks to its distinct times, and running sums over time maintain both counts. A key with
positive references at a time at which its existence count is 0 is an orphan then. The counts of
all keys can be kept as a table, to which later deltas are added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def existence_deltas(versions: DataFrame, key: str, valid_from: str, valid_to: str) -> DataFrame:
    """(key, at, delta): +1 where a version begins, -1 where it ends; a null end never comes."""
    ends = F.array(F.struct(F.col(valid_from).alias("at"), F.lit(1).alias("delta")), F.struct(F.col(valid_to).alias("at"), F.lit(-1).alias("delta")))
    return versions.select(F.col(key).alias("key"), F.explode(ends).alias("d")).select("key", "d.at", "d.delta").where(F.col("key").isNotNull() & F.col("at").isNotNull())


def record_series(rows: DataFrame, key: str, record: list[str], at: str, due: str | None = None) -> DataFrame:
    """(key, *record, seen) of every referring record: when it came, in order, as array of struct(at, due).

    ``due`` names the time of the next delivery that has to repeat the record, null where none
    has to. Repeated rows count once; rows with a null key or time take part nowhere, other nulls
    are values. One shuffle, combined on the map side; a record has an entry a delivery at most.
    """
    when = F.struct(F.col(at).alias("at"), (F.col(due) if due else F.lit(None).cast(rows.schema[at].dataType)).alias("due"))
    rows = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    return rows.groupBy(F.col(key).alias("key"), *record).agg(F.sort_array(F.collect_set(when)).alias("seen"))


def reference_deltas(series: DataFrame) -> DataFrame:
    """(key, at, delta, here): +1 where a record comes or comes back, -1 where a due delivery leaves it out.

    ``here`` is 1 where a row of the record stands, 0 where it was left out; a record that only
    goes on has delta 0.
    """
    seen = F.col("seen")

    def change(x: Column, i: Column) -> Column:
        before, after = F.get(seen, i - 1), F.get(seen, i + 1)
        alive = (i > 0) & (before["due"].isNull() | (before["due"] >= x["at"]))
        lost = x["due"].isNotNull() & (after.isNull() | (after["at"] > x["due"]))
        entry = lambda t, delta, here: F.struct(t.alias("at"), delta.cast("int").alias("delta"), F.lit(here).alias("here"))
        return F.filter(F.array(entry(x["at"], F.when(alive, 0).otherwise(1), 1), F.when(lost, entry(x["due"], F.lit(-1), 0))), lambda d: d.isNotNull())

    return series.select("key", F.explode(F.flatten(F.transform(seen, change))).alias("d")).select("key", "d.*")


def signed_counts(references: DataFrame, existence: DataFrame) -> DataFrame:
    """Both counts of every key at every instant of change.

    Returns (key, at, rows_here, references, existing, listed_before, listed_after):
    running counts include the deltas of the instant itself. Null keys take part nowhere; with
    an empty existence side every reference is an orphan.
    """
    both = references.select("key", "at", F.col("delta").alias("r"), "here", F.lit(0).alias("e")).unionByName(existence.select("key", "at", F.lit(0).alias("r"), F.lit(0).alias("here"), F.col("delta").alias("e")))
    net = both.groupBy("key", "at").agg(F.sum("r").alias("r"), F.sum("here").alias("here"), F.sum("e").alias("e"), F.max(F.col("e") > 0).alias("begins"))
    w = Window.partitionBy("key").orderBy("at")
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    return net.select(
        "key",
        "at",
        F.col("here").alias("rows_here"),
        F.sum("r").over(upto).alias("references"),
        F.sum("e").over(upto).alias("existing"),
        F.coalesce(F.max("begins").over(upto), F.lit(False)).alias("listed_before"),
        F.coalesce(F.max("begins").over(after), F.lit(False)).alias("listed_after"),
    )


def reason(listed_before: Column, listed_after: Column) -> Column:
    """`gone` (listed before, not now), `later` (first listed after) or `missing` (never)."""
    return F.when(listed_before, "gone").when(listed_after, "later").otherwise("missing")


def orphan_instants(references: DataFrame, existence: DataFrame) -> DataFrame:
    """(key, at, n_rows, n_references, reason): instants with rows and positive references of a key that does not exist then."""
    counts = signed_counts(references, existence).where((F.col("rows_here") > 0) & (F.col("references") > 0) & (F.col("existing") <= 0))
    return counts.select("key", "at", F.col("rows_here").alias("n_rows"), F.col("references").alias("n_references"), reason(F.col("listed_before"), F.col("listed_after")).alias("reason"))


def add_deltas(counts: DataFrame | None, references: DataFrame, existence: DataFrame) -> DataFrame:
    """(key, references, existing, ever): the stored counts of every key after further deltas.

    ``counts`` is such a table as an earlier run left it, None to begin with. Deltas combine on
    the map side, so a run costs its own deltas and one pass over the counts, not the past.
    An end in the open future (9999-12-31) is no change that has come.
    """
    past = existence.where(F.col("at").cast("string") < F.lit("9999-12-31"))
    parts = [
        references.select("key", F.col("delta").cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("e"), F.lit(False).alias("ever")),
        past.select("key", F.lit(0).cast("bigint").alias("r"), F.col("delta").cast("bigint").alias("e"), (F.col("delta") > 0).alias("ever")),
    ]
    if counts is not None:
        parts.append(counts.select("key", F.col("references").alias("r"), F.col("existing").alias("e"), "ever"))
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("r").alias("references"), F.sum("e").alias("existing"), F.max("ever").alias("ever"))


def current_orphans(counts: DataFrame) -> DataFrame:
    """(key, n_references, reason) of keys with positive references and zero existence."""
    return counts.where((F.col("references") > 0) & (F.col("existing") <= 0)).select("key", F.col("references").alias("n_references"), F.when(F.col("ever"), "gone").otherwise("missing").alias("reason"))
