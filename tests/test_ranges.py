import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import ranges


def spans(rng, n, keys):
    start = rng.integers(0, 5000, n)
    size = rng.choice([0, 1, 5, 40, 700, 4000], n, p=[0.2, 0.2, 0.2, 0.2, 0.15, 0.05])
    return [(k, int(rng.integers(keys)), int(a), int(a + s)) for k, (a, s) in enumerate(zip(start, size))]


@pytest.mark.parametrize("most", [3, 100_000])
def test_overlaps(spark, most):
    rng = np.random.default_rng(most)
    left, right = spans(rng, 120, 3), spans(rng, 150, 3)
    left += [(900, 0, -10**9, 10**9), (901, None, 1, 2), (902, 1, None, 5), (903, 1, 9, 4), (904, 2, -77, -77)]
    right += [(900, 0, -(10**12), 10**12), (901, None, 1, 2), (902, 1, 5, None), (905, 2, -77, -77)]
    a = spark.createDataFrame(left, "i int, k int, s long, e long")
    b = spark.createDataFrame(right, "j int, k int, x long, y long")
    got = sorted((r.i, r.j) for r in ranges.overlap_join(a, b, ["k"], ("s", "e"), ("x", "y"), 8.0, most).collect())
    ok = lambda k, s, e: None not in (k, s, e) and s <= e
    want = sorted((i, j) for i, k, s, e in left for j, m, x, y in right if k == m and ok(k, s, e) and ok(m, x, y) and s <= y and x <= e)
    assert got == want


def test_long_intervals_stay_few_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 1e12), (2, 5.0, 6.0)], "i int, s double, e double")
    placed = ranges._placed(rows, "s", "e", 1.0)
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())
    assert ranges._binned(placed, "s", "e", 1.0, levels, "_l").count() <= 2 * len(levels) + 2


def test_overlaps_of_nothing(spark):
    a = spark.createDataFrame([], "k int, s double, e double")
    b = spark.createDataFrame([(1, 0.5, 2.0)], "k int, x double, y double")
    assert ranges.overlap_join(a, b, ["k"], ("s", "e"), ("x", "y"), 1.0).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_as_of(spark, parts):
    """A key with most rows lies in several ranges; values are carried over ranges without any."""
    rng = np.random.default_rng(parts)
    key = lambda: 0 if rng.random() < 0.6 else int(rng.integers(1, 6))
    left = [(k, key(), int(rng.integers(0, 10_000))) for k in range(400)] + [(900, None, 5), (901, 1, None), (902, 99, 5), (903, 0, -5)]
    right = [(key(), int(t), k) for k, t in enumerate(np.concatenate([rng.integers(0, 300, 20), rng.integers(9000, 9900, 20), [50, 50]]))] + [(None, 1, 500), (0, None, 501)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a = spark.createDataFrame(left, "i int, k int, t long")
        b = spark.createDataFrame(right, "k int, at long, v int")
        for tolerance in (None, 500):
            got = {r.i: r.v for r in ranges.as_of_join(a, b, ["k"], "t", "at", ["v"], tie="v", tolerance=None if tolerance is None else F.lit(tolerance)).collect()}
            for i, k, t in left:
                best = max(((at, v) for m, at, v in right if None not in (k, t, m, at) and m == k and at <= t), default=None)
                want = best[1] if best and (tolerance is None or t - best[0] <= tolerance) else None
                assert got[i] == want, (i, k, t)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
