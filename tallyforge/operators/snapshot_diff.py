"""What changed between full snapshots, by subtracting invertible Bloom lookup tables.

Each record of a snapshot is an element (hash of the key, hash of key and values). Records are
brought together once, by hash bucket of their key. In each bucket the elements of a snapshot are
inserted into a lookup table: cells with a signed count and the XOR of the hashes and of a check
hash. The tables of two consecutive snapshots are subtracted cell by cell: what both hold
cancels, and only differing elements are left to peel. A table too full to peel is built again
larger, and a digest over all elements of the bucket verifies what was peeled. The recovered
key hashes lead to the records, whose real values classify them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import ship

#: Cells that each element goes to, one in each third of the table.
HASHES = 3
#: How much larger a table gets that could not be peeled.
ENLARGE = 4
_CHECK = 101
_STRIDE = 0x632BE59BD9B4E019

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxhash64_longs(*columns: np.ndarray) -> np.ndarray:
    """The public XXH64 hash of longs in a chain, each the seed of the next, as ``F.xxhash64`` gives it."""
    with np.errstate(over="ignore"):
        seed: np.ndarray | np.uint64 = np.uint64(42)
        for c in columns:
            h = seed + _P5 + np.uint64(8)
            h = h ^ (_rotl(c.astype(np.uint64) * _P2, 31) * _P1)
            seed = _mix(_rotl(h, 27) * _P1 + _P4)
    return seed.astype(np.int64)


def _places(kh: np.ndarray, vh: np.ndarray, third: int) -> list[np.ndarray]:
    return [np.mod(xxhash64_longs(kh, vh, np.full(len(kh), j, np.int64)), third) + j * third for j in range(HASHES)]


def _tables(group: np.ndarray, sign: np.ndarray, kh: np.ndarray, vh: np.ndarray, n_groups: int, third: int) -> tuple[np.ndarray, ...]:
    """Cells (count, key XOR, value XOR, check XOR) of all groups: later minus earlier snapshot."""
    C, K, V, X = (np.zeros(n_groups * third * HASHES, np.int64) for _ in range(4))
    check = xxhash64_longs(kh, vh, np.full(len(kh), _CHECK, np.int64))
    for place in _places(kh, vh, third):
        i = group * (third * HASHES) + place
        np.add.at(C, i, sign)
        np.bitwise_xor.at(K, i, kh)
        np.bitwise_xor.at(V, i, vh)
        np.bitwise_xor.at(X, i, check)
    return C, K, V, X


def _digest(group: np.ndarray, sign: np.ndarray, kh: np.ndarray, vh: np.ndarray, n_groups: int) -> np.ndarray:
    D = np.zeros((4, n_groups), np.int64)
    np.add.at(D[0], group, sign)
    for row, x in enumerate((kh, vh, xxhash64_longs(kh, vh, np.full(len(kh), _CHECK, np.int64))), 1):
        np.bitwise_xor.at(D[row], group, x)
    return D


def peel(tables: tuple[np.ndarray, ...], n_groups: int, third: int) -> tuple[np.ndarray, np.ndarray]:
    """Peel the subtracted tables of several groups at once.

    Returns the elements recovered as rows (group, key_hash, value_hash, sign) and a flag for each
    group whose cells were not all emptied.
    """
    C, K, V, X = tables
    size = third * HASHES
    out = [np.zeros((4, 0), np.int64)]
    look = np.flatnonzero(np.abs(C) == 1)
    while len(look):
        one = look[np.abs(C[look]) == 1]
        one = one[xxhash64_longs(K[one], V[one], np.full(len(one), _CHECK, np.int64)) == X[one]]
        if not len(one):
            break
        found = np.unique(np.stack([one // size, K[one], V[one], C[one]]), axis=1)
        out.append(found)
        g, k, v, s = found
        c = xxhash64_longs(k, v, np.full(len(k), _CHECK, np.int64))
        touched = []
        for place in _places(k, v, third):
            i = g * size + place
            np.subtract.at(C, i, s)
            np.bitwise_xor.at(K, i, k)
            np.bitwise_xor.at(V, i, v)
            np.bitwise_xor.at(X, i, c)
            touched.append(i)
        look = np.unique(np.concatenate(touched))
    failed = np.zeros(n_groups, bool)
    failed[np.flatnonzero((C != 0) | (K != 0) | (V != 0) | (X != 0)) // size] = True
    return np.concatenate(out, axis=1), failed


def differing_keys(group: np.ndarray, sign: np.ndarray, kh: np.ndarray, vh: np.ndarray, n_groups: int, cells: int) -> np.ndarray:
    """Flags of the elements whose key differs between the two sides of their group.

    Tables grow until they can be peeled and their digest is met; a group still failing when its
    table has more cells than twice its elements has all its elements flagged.
    """
    flags = np.zeros(len(group), bool)
    open_groups = np.ones(n_groups, bool)
    third = max(8, cells // HASHES)
    while open_groups.any():
        sel = np.flatnonzero(open_groups[group])
        names = np.cumsum(open_groups) - 1
        n_open = int(open_groups.sum())
        g, s, k, v = names[group[sel]], sign[sel], kh[sel], vh[sel]
        found, failed = peel(_tables(g, s, k, v, n_open, third), n_open, third)
        want = _digest(g, s, k, v, n_open)
        failed |= (_digest(found[0], found[3], found[1], found[2], n_open) != want).any(axis=0)
        good = ~failed[found[0]]
        keys = np.unique(found[1][good] ^ (found[0][good] * _STRIDE))
        flags[sel] = np.isin(k ^ (g * _STRIDE), keys) & ~failed[g]
        largest = np.bincount(g, minlength=n_open)
        hopeless = failed & (third * HASHES > 2 * largest)
        flags[sel] |= hopeless[g]
        open_groups[np.flatnonzero(open_groups)[~failed | hopeless]] = False
        third *= ENLARGE
    return flags


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values, nulls included, get equal numbers."""
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _unequal(column: pa.ChunkedArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = _codes(column)
    return x[a] != x[b]


def _bucket_diff(keys: list[str], values: list[str], cells: int):
    def run(rows: pa.Table) -> pa.Table:
        pairs = rows["pairs"].combine_chunks()
        row = pc.list_parent_indices(pairs).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pairs.flatten()
        pair = flat.field("pair").to_numpy(zero_copy_only=False).astype(np.int64)
        sign = flat.field("sign").to_numpy(zero_copy_only=False).astype(np.int64)
        names, group = np.unique(pair, return_inverse=True)
        kh, vh = (rows[c].combine_chunks().to_numpy(zero_copy_only=False)[row] for c in ("key_hash", "value_hash"))
        hit = np.flatnonzero(differing_keys(group.astype(np.int64), sign, kh, vh, len(names), cells))
        row, group, sign = row[hit], group[hit], sign[hit]
        # the recovered keys in full: a record of the earlier side meets the one of the later
        ids = np.unique(np.stack([group, *[_codes(rows[k])[row] for k in keys]]), axis=1, return_inverse=True)[1].reshape(-1) if len(row) else row
        was, now = (np.full(int(ids.max(initial=-1)) + 1, -1, np.int64) for _ in range(2))
        was[ids[sign < 0]], now[ids[sign > 0]] = row[sign < 0], row[sign > 0]
        of = np.zeros(len(was), np.int64)
        of[ids] = names[group] if len(row) else 0
        both = (was >= 0) & (now >= 0)
        other = np.zeros(len(was), bool)
        for v in values:
            other[both] |= _unequal(rows[v], was[both], now[both])
        kind = np.where(was < 0, "added", np.where(now < 0, "removed", np.where(other, "changed", "")))
        show = np.flatnonzero(kind != "")
        take = pa.array(np.where(now[show] >= 0, now[show], was[show]))
        return pa.table([pa.array(of[show], pa.int32()), *[rows[k].combine_chunks().take(take) for k in keys], pa.array(kind[show], pa.string())], names=["pair", *[k[2:] for k in keys], "change_type"])

    return run


def _key_hash(keys: dict[str, Column]) -> Column:
    return F.xxhash64(*[x for c in keys.values() for x in (c.isNull(), c)])


def bucket_of(keys: dict[str, Column], buckets: int) -> Column:
    """The hash bucket of a key, for callers who bring the rows of a bucket together themselves."""
    return F.pmod(F.xxhash64(F.lit("b"), _key_hash(keys)), F.lit(buckets)).cast("int")


def diff_pairs(sides: DataFrame, keys: dict[str, Column], values: dict[str, Column], pairs: Column, buckets: int, cells: int = 240, bucket: str | None = None) -> DataFrame:
    """Records added, removed or changed, for every pair of snapshots: (pair, *keys, change_type).

    ``sides`` has one row a record and snapshot (no repeated keys within one). ``pairs`` gives the
    array of struct(pair int, sign int) that a row takes part in: sign -1 as the earlier
    snapshot, +1 as the later. ``keys`` and ``values`` are expressions; values compare null-safe,
    null keys are keys. ``buckets`` hash buckets hold a table of ``cells`` cells for each pair to
    begin with; about ``cells`` / 1.3 differing elements can be peeled, more make the table grow
    ``ENLARGE`` fold, so the result is whole whatever the share of changes. An empty table gives
    no rows. Rows are shuffled once, by bucket (not at all where they lie by a column ``bucket``
    that holds :func:`bucket_of` already); a bucket holds many keys and a key few snapshots,
    so that buckets stay even however often one entity occurs in the keys.
    """
    ship(sides.sparkSession)
    key_hash = _key_hash(keys)
    value_hash = F.xxhash64(F.lit("v"), *[x for c in (*keys.values(), *values.values()) for x in (c.isNull(), c)])
    rows = sides.select(
        (F.col(bucket) if bucket else bucket_of(keys, buckets)).alias("bucket"),
        key_hash.alias("key_hash"),
        value_hash.alias("value_hash"),
        pairs.alias("pairs"),
        *[c.alias(f"k_{n}") for n, c in keys.items()],
        *[c.alias(f"v_{n}") for n, c in values.items()],
    ).where(F.size("pairs") > 0)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["pair int", *[f"`{n}` {kinds[f'k_{n}']}" for n in keys], "change_type string"])
    return rows.groupBy("bucket").applyInArrow(_bucket_diff([f"k_{n}" for n in keys], [f"v_{n}" for n in values], cells), schema)
