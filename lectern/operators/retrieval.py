"""Pairs of units and comments: fallback to all, similarity, top k, resume.

A video's units and comments meet by equality of ``video_id``. Vectors are compared in blocks of bounded
size, of which each gives its k best only, so neither pairs nor texts are carried through the ranking.
Similarities are compared to six digits, as single-precision vectors hold no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import dot


def comments_of(videos: DataFrame, comments: DataFrame) -> DataFrame:
    """A video's comments; a video that has none gets **every** comment.

    Only videos without comments meet all of them: that product is what is asked for, and it is made of
    the distinct ids that an anti-join leaves.
    """
    ids = videos.select("video_id").distinct()
    own = ids.join(comments, "video_id")
    none = ids.join(comments.select("video_id").distinct(), "video_id", "left_anti")
    return own.withColumn("fallback", F.lit(False)).unionByName(none.crossJoin(comments.drop("video_id")).withColumn("fallback", F.lit(True)))


def pairs(units: DataFrame, comments: DataFrame) -> DataFrame:
    """All pairs of a video's units and comments."""
    return units.join(comments, "video_id")


def top_k(units: DataFrame, comments: DataFrame, k: int = 50, keys: tuple[str, ...] = ("video_id", "unit_id"), a: str = "unit_vec", b: str = "comment_vec", idx: str = "comment_idx") -> DataFrame:
    """The ``k`` comments of greatest cosine for each unit; ties go to the smaller ``idx``. ``k`` = 0 keeps all pairs.

    ``idx`` must tell a video's comments apart, and ``keys`` (``video_id`` first) the units. Only ids and vectors are compared; the other
    columns are joined to what is found.
    """
    if not k:
        return pairs(units, comments).withColumn("sim", dot(F.col(a), F.col(b))).withColumn("rank", F.lit(None).cast("int"))
    unit = F.struct(*keys)
    found = top_k_of_vectors(units.select("video_id", unit.alias("_unit"), a), comments.select("video_id", idx, F.col(b).alias(a)), k, "_unit", idx, a, "video_id")
    found = found.select(*[F.col(f"_unit.{c}").alias(c) for c in keys], idx, "sim", "rank")
    return found.join(units, list(keys)).join(comments, ["video_id", idx])


def unfinished(units: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("video_id", "unit_id")) -> DataFrame:
    """Units without a result record."""
    return units.join(results.select(*keys).distinct(), list(keys), "left_anti")


#: Queries and rows of a block.
QUERIES, ROWS = 512, 8192


#: Queries of a block that are compared at once.
STRIPE = 64


def nearest(a, b, k: int):
    """Query, row and similarity of the ``k`` nearest rows of ``b`` for each of ``a``; ties to six digits go to the first row.

    A product of matrices tells which rows can be among them, within its error and the rounding; only those are summed in the
    order of the dimensions, so that equal rows have equal sums in every block.
    """
    import numpy as np

    about = np.nan_to_num(a @ b.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    if k < len(b):
        least = np.partition(about, len(b) - k, axis=1)[:, len(b) - k]
        norms = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1).max())
        slack = 2e-6 + 1e-12 * np.nan_to_num(norms, nan=np.inf, posinf=np.inf)
        with np.errstate(invalid="ignore"):
            floor = np.nan_to_num(least - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        i, j = np.nonzero(about >= floor[:, None])
    else:
        i, j = (x.ravel() for x in np.indices(about.shape))
    sims = np.zeros(len(i))
    for d in range(a.shape[1]):
        sims += a[i, d] * b[j, d]
    order = np.lexsort((j, -np.round(sims, 6), i))
    i, j, sims = i[order], j[order], sims[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], sims[kept]


def top_k_of_vectors(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, vec: str, by: str | None = None, size: tuple[int, int] = (QUERIES, ROWS)) -> DataFrame:
    """The ``k`` nearest rows of each query of a stated set, against all rows, or all of the same ``by``.

    Queries and rows are cut into blocks of about ``size``, as many as their numbers ask for. A block of either
    meets each of the other in one task, which returns the k best of each query, never the pairs.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    group = F.col(by) if by else F.lit(0)
    q = queries.select(group.alias("g"), F.col(query_id).alias("q"), F.col(vec).cast("array<double>").alias("v"))
    r = rows.select(group.alias("g"), F.col(row_id).alias("r"), F.col(vec).cast("array<double>").alias("v"))
    blocks = lambda n, each: F.ceil(F.col(n) / each).cast("int")
    counts = q.groupBy("g").agg(F.count(F.lit(1)).alias("nq")).join(r.groupBy("g").agg(F.count(F.lit(1)).alias("nr")), "g").select("g", blocks("nq", size[0]).alias("nq"), blocks("nr", size[1]).alias("nr"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (F.col(n) - 1).cast("long")))
    left = q.join(counts, "g").withColumn("block", F.pmod(F.xxhash64("q"), F.col("nq"))).withColumn("part", every("nr")).select("g", "block", "part", "q", "v")
    right = r.join(counts, "g").withColumn("part", F.pmod(F.xxhash64("r"), F.col("nr"))).withColumn("block", every("nq")).select("g", "block", "part", "r", "v")
    out = T.StructType([T.StructField("q", q.schema["q"].dataType), T.StructField("r", r.schema["r"].dataType), T.StructField("sim", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def score(qs: pa.Table, own: pa.Table) -> pa.Table:
        if not qs.num_rows or not own.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(out.fields, kinds)})
        own = own.take(pa.compute.sort_indices(own, [("r", "ascending")]))
        a, b = matrix(qs.column("v")), matrix(own.column("v"))
        best = [nearest(a[at : at + STRIPE], b, k) for at in range(0, len(a), STRIPE)]
        of = np.concatenate([x + n * STRIPE for n, (x, _, _) in enumerate(best)])
        return pa.table({"q": qs.column("q").take(pa.array(of)), "r": own.column("r").take(pa.array(np.concatenate([x[1] for x in best]))), "sim": np.concatenate([x[2] for x in best])})

    keys = ("g", "block", "part")
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, out)
    w = Window.partitionBy("q").orderBy(F.desc(F.round("sim", 6)), "r")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("r").alias(row_id), "sim", "rank")
