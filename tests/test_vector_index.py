import numpy as np
import pytest

from lectern.operators import vector_index as V


def data(spark, n, dims, groups, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    v = V.unit(centres[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, dims))) if groups else V.unit(rng.normal(size=(n, dims)))
    v = v.astype(np.float32).astype(float)
    return v, spark.createDataFrame([(int(k), x.tolist()) for k, x in enumerate(v)], "i long, e array<double>")


def truth(v, queries, k):
    sims = np.round(v[queries] @ v.T, 6)
    return {(int(q), int(r)) for q, s in zip(queries, sims) for r in np.lexsort((np.arange(len(s)), -s))[:k]}


@pytest.mark.parametrize("groups", [20, 0])
def test_exact(spark, groups):
    """Equal to comparing all, in clusters and where there are none."""
    v, rows = data(spark, 600, 8, groups)
    index = V.build(rows.withColumnRenamed("i", "j"), "j", "e", 24)
    assert index.rows.count() == 600
    q = rows.where("i % 20 = 0")
    got = {(r.i, r.j) for r in V.exact(index, q, 5, "i", "e", 2).collect()}
    assert got == truth(v, np.arange(0, 600, 20), 5)


def test_recall(spark):
    v, rows = data(spark, 1500, 12, 40, 3)
    index = V.build(rows.withColumnRenamed("i", "j"), "j", "e", 40, sample=500)
    q = rows.where("i % 30 = 0")
    probes, got = V.calibrate(index, q, 10, "i", "e")
    want = truth(v, np.arange(0, 1500, 30), 10)
    found = {(r.i, r.j) for r in V.search(index, q, 10, "i", "e", probes).collect()}
    assert len(found & want) / len(want) >= 0.95 and got >= 0.95 and probes < 40


def test_ties_nulls_and_small_tables(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(6)] + [(6, None), (7, [0.0, 0.0]), (8, [-1.0, 0.0])], "j int, e array<double>")
    index = V.build(rows, "j", "e", 3)
    got = [(r.j, round(r.sim, 6)) for r in V.exact(index, rows.where("j = 0").withColumnRenamed("j", "i"), 3, "i", "e", 1).orderBy("rank").collect()]
    assert got == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert V.exact(index, rows.where("j = 0").withColumnRenamed("j", "i"), 20, "i", "e", 1).count() == 8
    empty = V.build(rows.limit(0), "j", "e")
    assert V.exact(empty, rows.withColumnRenamed("j", "i"), 3, "i", "e").collect() == []


def test_an_emptied_cell_starts_anew():
    v = np.repeat(V.unit(np.array([[1.0, 0], [0, 1.0], [-1.0, 0.1]])), [50, 3, 1], axis=0)
    centres = V.fit_centres(v, 3)
    assert (V.angles(v, centres).min(1) < 1e-6).all()
