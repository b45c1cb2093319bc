"""History of changing attributes: a type-two dimension built from periodic full snapshots.

The merge rule is one and the same in both forms offered here. The hash of the attributes that
arrive is compared with the hash of the version now open; if they differ, the open version is
closed with the arrival's date and a new open version is inserted; a key that a snapshot no
longer lists has its version closed with that snapshot's date.

``merge_snapshot`` applies the rule to a stored history and one arriving snapshot, for runs
that come with each delivery. ``build_history`` applies it to a whole series of snapshots: the
rows of a key are few (one a snapshot at most, whatever the size of the table), so every key
is folded through the merge on its own, in one shuffle and inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.dedupe import keep_last

OPEN_END = "9999-12-31"

#: A calendar of snapshots has a row a day at most; a longer one is joined by shuffle.
MAX_SNAPSHOTS = 50_000


def snapshot_calendar(rows: DataFrame, date: str) -> tuple[DataFrame, int]:
    """The distinct dates in order, (snap_date, snap_no from 0, next_date; null after the newest), and the number of dated rows.

    A bounded number of dates is read to the driver and comes back as a broadcast local table;
    more than ``MAX_SNAPSHOTS`` stay a table that the planner joins as it sees fit.
    """
    days = rows.select(F.col(date).alias("snap_date")).where(F.col("snap_date").isNotNull()).groupBy("snap_date").agg(F.count("*").alias("n"))
    got = sorted(tuple(r) for r in days.limit(MAX_SNAPSHOTS + 1).collect())
    if len(got) <= MAX_SNAPSHOTS:
        lines = [(day, i, got[i + 1][0] if i + 1 < len(got) else None) for i, (day, _) in enumerate(got)]
        return F.broadcast(rows.sparkSession.createDataFrame(lines, "snap_date date, snap_no int, next_date date")), sum(n for _, n in got)
    w = Window.partitionBy(F.lit(0)).orderBy("snap_date")
    numbered = days.select("snap_date", (F.row_number().over(w) - 1).alias("snap_no"), F.lead("snap_date").over(w).alias("next_date"))
    return numbered, days.agg(F.sum("n")).first()[0]


def attribute_hash(attributes: list[Column]) -> Column:
    """64-bit hash of the attributes; a null hashes apart from any text."""
    return F.xxhash64(*[x for a in attributes for x in (a.isNull(), a)])


def build_history(snapshots: DataFrame, key: Column, date: Column, attributes: dict[str, Column], loaded: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every version of every key: (key, *attributes, valid_from, valid_to, hash, newest).

    ``snapshots`` holds full snapshots, one for each distinct ``date``. A version is a longest
    run of consecutive snapshots that list the key with the same attributes; it is valid from
    its first date (inclusive) to the date of the snapshot after the run (exclusive), or to
    9999-12-31 if the run reaches the newest snapshot; absence
    ends it. For the attributes named in ``carry`` a null states nothing: the last stated one of
    the unbroken presence holds. Of several rows of a key in one snapshot the one loaded last
    counts, of ties the greatest attributes; equal rows count once. Rows with a null key or date
    take part nowhere. ``newest`` marks the last version of a key. An empty table gives no rows.
    """
    names = list(attributes)
    src = snapshots.select(key.alias("key"), date.alias("snap_date"), loaded.alias("loaded"), *[a.alias(f"a_{n}") for n, a in attributes.items()]).where(F.col("key").isNotNull() & F.col("snap_date").isNotNull())
    rows = keep_last(src, {"key": F.col("key"), "snap_date": F.col("snap_date")}, [F.col("loaded")], {f"a_{n}": F.col(f"a_{n}") for n in names})
    rows = rows.join(snapshot_calendar(src, "snap_date")[0], "snap_date")
    series = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("snap_no", "snap_date", "next_date", *[F.col(f"a_{n}") for n in names]))).alias("series"))
    return _fold(series, names, carry)


def _fold(series: DataFrame, names: list[str], carry: tuple[str, ...]) -> DataFrame:
    """Every key's snapshots through the merge rule, in order: state is (closed versions, open version)."""
    kinds = {f.name: f.dataType.simpleString() for f in series.schema["series"].dataType.elementType.fields}
    version = "struct<" + ",".join(["valid_from:date", "valid_to:date", "last_no:int", "hash:bigint"] + [f"a_{n}:{kinds[f'a_{n}']}" for n in names]) + ">"
    start = F.struct(F.array().cast(f"array<{version}>").alias("closed"), F.lit(None).cast(version).alias("open"))

    def merge(state: Column, row: Column) -> Column:
        current = state["open"]
        present = current.isNotNull() & (current["last_no"] == row["snap_no"] - 1)
        attrs = {n: F.when(present, F.coalesce(row[f"a_{n}"], current[f"a_{n}"])).otherwise(row[f"a_{n}"]) if n in carry else row[f"a_{n}"] for n in names}
        arrived = attribute_hash(list(attrs.values()))
        same = present & (current["hash"] == arrived)
        for n in names:  # the hash finds the change, the attributes settle it
            same = same & current[f"a_{n}"].eqNullSafe(attrs[n])
        # the end that the open version gets if the next snapshot doesn't bear it out
        born = F.struct(F.when(same, current["valid_from"]).otherwise(row["snap_date"]).alias("valid_from"), row["next_date"].alias("valid_to"), row["snap_no"].alias("last_no"), arrived.alias("hash"), *[attrs[n].alias(f"a_{n}") for n in names]).cast(version)
        closed = F.when(current.isNull() | F.coalesce(same, F.lit(False)), state["closed"]).otherwise(F.concat(state["closed"], F.array(current)))
        return F.struct(closed.alias("closed"), born.alias("open"))

    folded = series.select("key", F.aggregate("series", start, merge, lambda s: F.concat(s["closed"], F.array(s["open"]))).alias("versions"))
    out = folded.select("key", F.size("versions").alias("n"), F.posexplode("versions").alias("pos", "v"))
    return out.select("key", *[F.col(f"v.a_{n}").alias(n) for n in names], F.col("v.valid_from").alias("valid_from"), F.coalesce(F.col("v.valid_to"), F.lit(OPEN_END).cast("date")).alias("valid_to"), F.col("v.hash").alias("hash"), (F.col("pos") == F.col("n") - 1).alias("newest"))


def merge_snapshot(history: DataFrame, snapshot: DataFrame, as_of: Column, attributes: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """One merge step: a stored history and the snapshot that arrives next.

    ``history`` has (key, *attributes, valid_from, valid_to, hash), open versions with valid_to
    9999-12-31; ``snapshot`` has (key, *attributes), a row a key, none null. Closed versions pass
    through untouched, so with a history partitioned by open or closed only the open part is
    read into the join. Returns the history after the step, with the same columns.
    """
    end = F.lit(OPEN_END).cast("date")
    cols = ["key", *attributes, "valid_from", "valid_to", "hash"]
    history = history.select(*cols)
    closed, opened = history.where(F.col("valid_to") != end), history.where(F.col("valid_to") == end)
    old = opened.select("key", *[F.col(c).alias(f"o_{c}") for c in cols[1:]], F.lit(True).alias("had"))
    new = snapshot.select("key", *[F.col(a).alias(f"n_{a}") for a in attributes], F.lit(True).alias("has"))
    both = old.join(new, "key", "full")
    stated = {a: F.coalesce(F.col(f"n_{a}"), F.col(f"o_{a}")) if a in carry else F.col(f"n_{a}") for a in attributes}
    arrived = attribute_hash(list(stated.values()))
    same = F.col("had").isNotNull() & F.col("has").isNotNull() & (F.col("o_hash") == arrived)
    for a in attributes:
        same = same & F.col(f"o_{a}").eqNullSafe(stated[a])
    kept = F.struct(*[F.col(f"o_{a}").alias(a) for a in attributes], F.col("o_valid_from").alias("valid_from"), F.when(same, end).otherwise(as_of).alias("valid_to"), F.col("o_hash").alias("hash"))
    born = F.struct(*[stated[a].alias(a) for a in attributes], as_of.alias("valid_from"), end.alias("valid_to"), arrived.alias("hash"))
    versions = F.filter(F.array(F.when(F.col("had").isNotNull(), kept), F.when(F.col("has").isNotNull() & ~F.coalesce(same, F.lit(False)), born)), lambda v: v.isNotNull())
    after = both.select("key", F.explode(versions).alias("v")).select("key", *[F.col(f"v.{c}").alias(c) for c in cols[1:]])
    return closed.unionByName(after)
