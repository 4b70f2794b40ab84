"""Inverted lists for the nearest unit vectors: k-means cells, rows stored by cell, probes widened as far as needed.

``build`` fits the centres of the cells on a sample of at most ``sample`` rows, chosen by a hash of their ids, and puts **every**
row into the cell of its nearest centre; each cell keeps the greatest angle of its rows to the centre. ``search`` compares a query
with the rows of its ``probes`` nearest cells. ``exact`` goes on from there: a cell whose centre lies further from the query than the
k-th best found so far plus the cell's own angle cannot hold a better row (triangle inequality of angles); all other cells are
searched as well, so the result is that of comparing all. ``calibrate`` doubles the probes until a recall is reached
on stated queries. Cells are compared in blocks of bounded size, of which each gives its k best only, so a cell with a third of all rows
is many tasks.

The driver holds the sample, the centres and one row for each cell (``MOST_CELLS`` at most). Vectors must have one length;
rows without a vector are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import written
from .retrieval import top_k_of_vectors

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 12
#: Similarities are compared to six digits; bounds leave them room.
SLACK = 2e-6


@dataclass
class VectorIndex:
    """``rows`` has ``cell``, ``row_id`` and ``vec``; ``radius`` the greatest angle of each cell, -1 where it is empty."""

    centres: np.ndarray
    radius: np.ndarray
    rows: DataFrame
    row_id: str


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def angles(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(v) @ centres.T, -1.0, 1.0))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means: centres start at rows of the sample; an emptied cell starts anew at the row that is worst placed."""
    v = unit(sample)
    centres = v[np.random.default_rng(seed).choice(len(v), min(cells, len(v)), replace=False)].copy()
    for _ in range(rounds):
        sims = v @ centres.T
        own = sims.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = v[np.argsort(sims.max(1))[: len(empty)]]
        centres = unit(sums)
    return centres


def build(rows: DataFrame, row_id: str, vec: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """The index of all rows; by default the square root of their number is the number of cells."""
    own = rows.where(F.col(vec).isNotNull()).select(F.col(row_id), F.col(vec).cast("array<double>").alias("vec"))
    cells = cells or min(MOST_CELLS, max(1, math.isqrt(own.count())))
    chosen = own.orderBy(F.xxhash64(row_id)).limit(max(sample, cells)).select("vec").toArrow()
    centres = fit_centres(matrix(chosen.column("vec")), cells) if chosen.num_rows else np.zeros((1, 1))
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), *own.schema.fields])

    def place(batches):
        for b in batches:
            if b.num_rows:
                found = angles(matrix(b.column("vec")), centres)
                cell = found.argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(found[np.arange(len(cell)), cell]), *b.columns], names=schema.fieldNames())

    placed = written(own.mapInArrow(place, schema))
    radius = np.full(len(centres), -1.0)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius")).collect():  # one row for each cell
        radius[r.cell] = r.radius
    return VectorIndex(centres, radius, placed.drop("angle"), row_id)


def probed(index: VectorIndex, queries: DataFrame, query_id: str, choose, extra: tuple[str, ...] = ()) -> DataFrame:
    """(``cell``, query, ``vec``) for the cells that ``choose`` gives: a mask from angles (a row for each query) and the columns ``extra``."""
    centres, radius = index.centres, index.radius
    schema = T.StructType([T.StructField("cell", T.IntegerType()), queries.schema[query_id], T.StructField("vec", T.ArrayType(T.DoubleType()))])
    kind = to_arrow_type(schema["vec"].dataType)

    def run(batches):
        for b in batches:
            if not b.num_rows or (radius < 0).all():
                continue
            mask = choose(angles(matrix(b.column("vec")), centres), radius, *[b.column(c).to_numpy(zero_copy_only=False) for c in extra]) & (radius >= 0)
            q, cell = np.nonzero(mask)
            at = pa.array(q)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(query_id).take(at), b.column("vec").take(at).cast(kind)], names=schema.fieldNames())

    return queries.select(query_id, "vec", *extra).mapInArrow(run, schema)


def nearest_cells(probes: int):
    def choose(found: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The nearest cells that have rows."""
        found = np.where(radius < 0, np.inf, found)
        mask = np.zeros(found.shape, bool)
        np.put_along_axis(mask, np.argpartition(found, min(probes, found.shape[1]) - 1, axis=1)[:, :probes], True, axis=1)
        return mask

    return choose


def asked(queries: DataFrame, query_id: str, vec: str) -> DataFrame:
    return queries.where(F.col(vec).isNotNull()).select(query_id, F.col(vec).cast("array<double>").alias("vec"))


def search(index: VectorIndex, queries: DataFrame, k: int, query_id: str, vec: str, probes: int) -> DataFrame:
    """``query_id``, ``row_id``, ``sim`` and ``rank`` of the ``k`` best rows in the ``probes`` nearest cells of each query."""
    own = probed(index, asked(queries, query_id, vec), query_id, nearest_cells(probes))
    return top_k_of_vectors(own, index.rows, k, query_id, index.row_id, "vec", "cell")


def exact(index: VectorIndex, queries: DataFrame, k: int, query_id: str, vec: str, probes: int = 4) -> DataFrame:
    """The same over all rows: cells that the bounds do not rule out are searched in a second step."""
    own = asked(queries, query_id, vec)
    first = written(search(index, own, k, query_id, "vec", probes))
    reach = first.groupBy(query_id).agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(-2.0).alias("least"))
    taken = nearest_cells(probes)

    def choose(found: np.ndarray, radius: np.ndarray, least: np.ndarray) -> np.ndarray:
        limit = np.where(least < -1, np.pi, np.arccos(np.clip(least - SLACK, -1.0, 1.0)))
        return (found - radius[None, :] <= limit[:, None] + SLACK) & ~taken(found, radius)

    known = own.join(reach, query_id, "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    rest = top_k_of_vectors(probed(index, known, query_id, choose, ("least",)), index.rows, k, query_id, index.row_id, "vec", "cell")
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("sim", 6)), index.row_id)
    both = first.drop("rank").unionByName(rest.drop("rank"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, query_id: str, row_id: str) -> float:
    """The share of the true pairs that were found."""
    hits, n = truth.join(found.select(query_id, row_id, F.lit(1).alias("hit")), [query_id, row_id], "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    return hits / n if n else 1.0


def calibrate(index: VectorIndex, queries: DataFrame, k: int, query_id: str, vec: str, target: float = 0.95) -> tuple[int, float]:
    """The fewest probes of 1, 2, 4, ... that reach ``target`` on the queries, and the recall that they have."""
    truth = written(exact(index, queries, k, query_id, vec))
    probes = 1
    while True:
        got = recall(search(index, queries, k, query_id, vec, probes), truth, query_id, index.row_id)
        if got >= target or probes >= len(index.centres):
            return probes, got
        probes *= 2
