"""Attributes as known at event time: every event with the version valid and recorded then."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import cut, ship

#: Events of an entity that go to one salt of its own; a hotter entity is spread over several.
EVENTS_PER_SALT = 20_000

#: Hot entities of which a list is broadcast; more are joined by shuffle.
MAX_HOT = 100_000

#: Rows of both sides to a bucket of entities, so that a group stays a few MB however much data there is.
ROWS_PER_BUCKET = 20_000


def _latest(events: pa.Table, versions: pa.Table) -> pa.Array:
    """Row of ``versions`` that each event sees, null where none; both sides sorted by Arrow.

    Versions are put in order of (entity, instant they are both valid and recorded); an event
    finds the last one at or before it by one binary search over the composite key.
    """
    ids = pa.concat_arrays([versions["entity"].combine_chunks(), events["entity"].combine_chunks()]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    nv = versions.num_rows
    known = versions["known"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    start = versions["start"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    at = events["at"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((versions["tie"].combine_chunks().to_numpy(zero_copy_only=False), start, known, ids[:nv]))
    # of the versions known by then the one that starts last is in force: carry it forward
    ent = ids[:nv][order]
    instants = np.unique(start[order], return_inverse=True)[1].astype(np.int64)
    entity_rank = np.cumsum(np.concatenate([[0], (np.diff(ent) != 0).astype(np.int64)])) if nv else ent
    latest = entity_rank * (nv + 1) + instants
    at_best = np.where(latest == np.maximum.accumulate(latest), np.arange(nv), 0)
    best = order[np.maximum.accumulate(at_best)]
    times = np.concatenate([known[order], at])
    rank = np.unique(times, return_inverse=True)[1].astype(np.int64)
    width = int(rank.max(initial=0)) + 1
    keys = ent * width + rank[:nv]
    probe = ids[nv:] * width + rank[nv:]
    pos = np.searchsorted(keys, probe, side="right") - 1
    hit = (pos >= 0) & (ent[np.clip(pos, 0, max(nv - 1, 0))] == ids[nv:]) if nv else np.zeros(len(at), bool)
    return pa.array(np.where(hit, best[np.clip(pos, 0, max(nv - 1, 0))], 0) if nv else np.zeros(len(at), np.int64), mask=~hit)


def _hot_entities(events: DataFrame) -> DataFrame | None:
    """(entity, salts) of entities with more than EVENTS_PER_SALT events; None where there are none."""
    counts = events.where(F.col("entity").isNotNull()).groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") > EVENTS_PER_SALT)
    hot = cut(counts.select("entity", F.ceil(F.col("n") / EVENTS_PER_SALT).cast("int").alias("salts")), "hot-entities")
    n = hot.count()
    return F.broadcast(hot) if 0 < n <= MAX_HOT else hot if n else None


def as_known(events: DataFrame, versions: DataFrame, entity: str, at: str, valid_from: str, attributes: list[str], valid_to: str | None = None, recorded: str | None = None, keep: list[str] | None = None, bounded: bool = False, rows: int | None = None) -> DataFrame:
    """Every event with ``attributes`` of the latest version valid and recorded by its time.

    Columns of the result: the event's ``entity``, ``at`` and ``keep``, then ``attributes``
    (suffixed ``_then`` where a name clashes with an event column) and ``known_from``, null where no
    version applied. A version applies from the later of ``valid_from`` and ``recorded`` (where
    given) and, with ``valid_to``, only before it; a version that became known later is never
    seen. Of versions known at an instant the one that starts last wins, of those with one start
    the one recorded last, then the one whose attributes hash highest, whatever the order of rows. Times are dates or
    timestamps of one type on both sides. Events with a null entity or time come out with null
    attributes; versions with a null entity or start are never seen. Repeated events all come out.

    Events and versions are co-grouped by entity, entities packed into buckets; an entity with
    more than ``EVENTS_PER_SALT`` events is spread over salts and its versions are sent to each,
    so no group is unbounded in its events. Hot entities are found by a count that combines on
    the map side and written once; the list is broadcast after its rows were counted. A caller
    who knows that no entity has many events (one a month, say) leaves that out with ``bounded``.
    Buckets hold about ``ROWS_PER_BUCKET`` rows: their number follows ``rows``, which a caller may
    give as an upper bound; else both sides are counted.
    """
    keep = keep or []
    spark = events.sparkSession
    ship(spark)
    names = [entity, at, *keep]
    out_names = [f"{a}_then" if a in names else a for a in attributes]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ev = events.select(F.col(entity).alias("entity"), micros(at).alias("at"), *[F.col(c).alias(f"e_{i}") for i, c in enumerate(names)])
    known = F.greatest(micros(valid_from), micros(recorded)) if recorded else micros(valid_from)
    ve = versions.select(
        F.col(entity).alias("entity"),
        known.alias("known"),
        micros(valid_from).alias("start"),
        (micros(valid_to) if valid_to else F.lit(None).cast("bigint")).alias("until"),
        F.col(valid_from).alias("known_from"),
        *[F.col(a).alias(f"a_{i}") for i, a in enumerate(attributes)],
        F.xxhash64(*attributes).alias("tie"),
    ).where(F.col("entity").isNotNull() & F.col("start").isNotNull() & F.col("known").isNotNull())

    hot = None if bounded else _hot_entities(ev)
    if hot is None:
        ev, ve = ev.withColumn("salt", F.lit(0)), ve.withColumn("salt", F.lit(0))
    else:
        spread = F.pmod(F.xxhash64(*[f"e_{i}" for i in range(len(names))], F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int")
        ev = ev.join(hot, "entity", "left").withColumn("salt", spread).drop("salts")
        ve = ve.join(hot, "entity", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    n = rows if rows is not None else events.count() + versions.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / ROWS_PER_BUCKET))
    bucket = F.pmod(F.xxhash64("entity", "salt"), F.lit(buckets)).cast("int")
    ev, ve = ev.withColumn("bucket", bucket).drop("salt"), ve.withColumn("bucket", bucket).drop("salt")

    shown = ev.select(*[F.col(f"e_{i}").alias(n) for i, n in enumerate(names)]).schema
    attrs = ve.select(*[F.col(f"a_{i}").alias(n) for i, n in enumerate(out_names)], "known_from").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*shown, *attrs])
    labels = [f.name for f in [*shown, *attrs]]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _latest_with_end(left, right)
        seen = [right[f"a_{i}"].combine_chunks().take(rows) for i in range(len(attributes))] + [right["known_from"].combine_chunks().take(rows)]
        return pa.table([left[f"e_{i}"] for i in range(len(names))] + seen, names=labels)

    matched = ev.where(F.col("entity").isNotNull() & F.col("at").isNotNull()).groupBy("bucket").cogroup(ve.groupBy("bucket")).applyInArrow(join, schema)
    blank = ev.where(F.col("entity").isNull() | F.col("at").isNull()).select(*[F.col(f"e_{i}").alias(n) for i, n in enumerate(names)], *[F.lit(None).cast(f.dataType).alias(f.name) for f in attrs])
    return matched.unionByName(blank)


def _latest_with_end(events: pa.Table, versions: pa.Table) -> pa.Array:
    rows = _latest(events, versions)
    if versions.num_rows == 0 or versions["until"].null_count == versions.num_rows:
        return rows
    until = versions["until"].combine_chunks().take(rows)
    at = events["at"].combine_chunks()
    over = pc.fill_null(pc.greater_equal(at, until), False)
    return pc.if_else(over, pa.scalar(None, rows.type), rows)
