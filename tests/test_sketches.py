import numpy as np
from pyspark.sql import functions as F

from lectern.operators import sketches


def test_merged_sketches_stay_within_their_bounds(spark):
    rng = np.random.default_rng(2)
    rows = [("a", int(k % 7), int(v), float(x), int(min(rng.zipf(1.5), 500))) for k, (v, x) in enumerate(zip(rng.integers(0, 3000, 8000), rng.normal(size=8000)))]
    rows += [("b", 0, 1, 2.0, 3), ("b", 1, None, None, None)]
    df = spark.createDataFrame(rows, "g string, day int, v long, x double, item long")
    stored = sketches.daily(df, ["g"], F.col("day"), "v", "x", "item")
    assert stored.count() == 9
    marks = (0.05, 0.5, 0.95)
    found = sketches.estimates(sketches.merged(stored, ["g"]), ["g"], marks, 3)
    got = {r.g: r for r in found.collect()}
    exact = len({r[2] for r in rows if r[0] == "a"})
    assert abs(got["a"].distinct - exact) <= sketches.DISTINCT_ERROR * exact and got["b"].distinct == 1
    errors = {r.g: r.rank_error for r in sketches.rank_errors(df.where("x is not null"), found, ["g"], "x", marks).collect()}
    assert errors["a"] <= sketches.RANK_ERROR and errors["b"] <= 0.0 + 1e-12
    counts = {}
    for r in rows:
        if r[0] == "a":
            counts[r[4]] = counts.get(r[4], 0) + 1
    assert [(t.item, t["count"]) for t in got["a"].top] == sorted(counts.items(), key=lambda x: -x[1])[:3]
    assert got["a"].n == 8000 and got["b"].n == 2


def test_more_items_than_a_sketch_tracks(spark):
    """25,000 items of two rows each and five of more: no sketch can name them, so they are counted."""
    often = [(k, 3 + k) for k in range(5)]
    rows = spark.range(25_000).select(F.lit("many").alias("g"), F.explode(F.array_repeat(F.col("id") + 10, 2)).alias("item"))
    rows = rows.unionAll(spark.createDataFrame([("many", k) for k, n in often for _ in range(n)], "g string, item long")).unionAll(spark.createDataFrame([("few", 7), ("few", 7), ("few", 8), ("few", None)], "g string, item long"))
    rows = rows.withColumns({"v": F.col("item"), "x": F.lit(1.0), "day": F.pmod(F.xxhash64("item"), F.lit(3))})
    found = sketches.estimates(sketches.merged(sketches.daily(rows, ["g"], F.col("day"), "v", "x", "item"), ["g"]), ["g"])
    got = {r.g: [(t.item, t["count"]) for t in r.top] for r in sketches.settled_top(rows, found, ["g"], "item").collect()}
    assert got["many"] == sorted(often, key=lambda x: -x[1])
    assert got["few"][0] == (7, 2) and sorted(got["few"][1:], key=str) == [(8, 1), (None, 1)]
