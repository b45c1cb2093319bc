import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators.snapshot_diff import diff_pairs, differing_keys, xxhash64_longs


def test_hash_is_sparks(spark):
    r = np.random.default_rng(1)
    a, b = r.integers(-(2**63), 2**63 - 1, 50), r.integers(-(2**63), 2**63 - 1, 50)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a bigint, b bigint")
    assert [x[0] for x in df.select(F.xxhash64("a", "b")).collect()] == xxhash64_longs(a, b).tolist()


@pytest.mark.parametrize("changes", [0, 5, 400, 3000])
@pytest.mark.parametrize("cells", [24, 240])
def test_tables_grow_until_peeled(changes, cells):
    r = np.random.default_rng(changes)
    kh = r.integers(-(2**63), 2**63 - 1, 3000)
    vh = kh * 3
    other = vh.copy()
    other[:changes] ^= 1
    g = np.zeros(6000, np.int64)
    sign = np.repeat([-1, 1], 3000)
    flags = differing_keys(g, sign, np.concatenate([kh, kh]), np.concatenate([vh, other]), 1, cells)
    want = np.arange(3000) < changes
    assert (flags == np.concatenate([want, want])).all()


@pytest.mark.parametrize("buckets", [1, 5])
@pytest.mark.parametrize("cells", [24, 240])
def test_against_brute_force(spark, rows, buckets, cells):
    r = random.Random(buckets)
    key = lambda i: (None if i == 3 else f"k{i}", i % 7)
    snaps = []
    for s in range(4):
        snaps.append({key(i): (r.choice([1, 1, 1, 2, None]), r.choice([True, True, None])) for i in range(300) if r.random() < 0.9})
    data = [(s, k, n, v, f, 0) for s, snap in enumerate(snaps) for (k, n), (v, f) in snap.items()]
    df = spark.createDataFrame(data, "s int, k string, n int, v int, f boolean, bucket int")
    side = lambda no, sign: F.struct(no.cast("int").alias("pair"), F.lit(sign).alias("sign"))
    pairs = F.filter(F.array(F.when(F.col("s") > 0, side(F.col("s"), 1)), F.when(F.col("s") < 3, side(F.col("s") + 1, -1))), lambda x: x.isNotNull())
    got = diff_pairs(df, {"k": F.col("k"), "n": F.col("n")}, {"v": F.col("v"), "f": F.col("f")}, pairs, buckets, cells)
    want = []
    for s in range(1, 4):
        a, b = snaps[s - 1], snaps[s]
        for k in a.keys() | b.keys():
            kind = "added" if k not in a else "removed" if k not in b else "changed" if a[k] != b[k] else None
            if kind:
                want.append((s, *k, kind))
    assert sorted(rows(got), key=str) == sorted(want, key=str)
    assert diff_pairs(df.limit(0), {"k": F.col("k")}, {"v": F.col("v")}, pairs, buckets, cells).count() == 0
