"""Mergeable sketches of a column: distinct values, quantiles and the most frequent values, with the bounds of their errors.

``daily`` gives one row of sketches for each key and part (a day); stored, they are merged over any parts without the rows.
``merged`` merges them and ``estimates`` reads them. All are Spark's own aggregates, so sketches are made before the shuffle.

distinct  | HyperLogLog of 2**LG registers  | relative standard error 1.04 / sqrt(2**LG)
quantiles | KLL of size K                   | rank error of about 2.3 / K**0.9 with a confidence of 0.99
top       | frequent items, TRACKED of them | a count is too high by n / (0.75 * TRACKED) at most; exact while no more are different (``settled_top`` counts the rest)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LG, K, TRACKED = 14, 400, 10_000
#: Three standard errors of a distinct count, and the rank error of a quantile.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG / 2), 2.3 / K**0.9


def daily(rows: DataFrame, by: list[str], part: Column, distinct: str, value: str, item: str) -> DataFrame:
    """``by``, ``part`` and the sketches ``distinct`` (of a column), ``quantiles`` (of numbers) and ``top`` (of items)."""
    return rows.groupBy(*by, part.alias("part")).agg(*_sketches(distinct, value, item))


def whole(rows: DataFrame, by: list[str], distinct: str, value: str, item: str) -> DataFrame:
    """The same over all parts, from the rows."""
    return rows.groupBy(*by).agg(*_sketches(distinct, value, item))


def _sketches(distinct: str, value: str, item: str) -> list[Column]:
    return [
        F.hll_sketch_agg(distinct, LG).alias("distinct"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate({item}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"),
    ]


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of several parts as one for each key."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top"), F.sum("n").alias("n"))


def estimates(sketches: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.5,), k: int = 5) -> DataFrame:
    """``by``, ``n``, ``distinct``, ``quantiles`` (an array) and ``top`` (items and counts, the most frequent first)."""
    q = F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(x)) for x in quantiles])
    return sketches.select(*by, "n", F.hll_sketch_estimate("distinct").alias("distinct"), q.alias("quantiles"), F.expr(f"approx_top_k_estimate(top, {k})").alias("top"))


def settled_top(rows: DataFrame, found: DataFrame, by: list[str], item: str, k: int = 5) -> DataFrame:
    """``found`` with ``top`` counted from the rows for keys with more than ``TRACKED`` different items, of which the sketch had to drop some.

    A sketch names only items that it is sure of: of many about equally frequent ones, none. Rows are counted by item before
    they are shuffled, and of the counts each key keeps ``k``.
    """
    counts = rows.groupBy(*by, item).agg(F.count(F.lit(1)).alias("count"))
    kinds = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_kinds"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), item))
    best = counts.withColumn("_k", place).where(F.col("_k") <= k).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_k", item, "count"))).alias("_best"))
    exact = F.transform("_best", lambda x: F.struct(x[item].alias("item"), x["count"].alias("count")))
    joined = found.join(kinds, by, "left").join(best, by, "left")
    return joined.withColumn("top", F.when(F.col("_kinds") > TRACKED, exact).otherwise(F.col("top"))).drop("_kinds", "_best")


def rank_errors(rows: DataFrame, found: DataFrame, by: list[str], value: str, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """``by`` and ``rank_error``: the greatest distance between a quantile and the ranks that its value really has."""
    each = found.select(*by, F.posexplode("quantiles").alias("k", "q"))
    near = rows.join(each, by).groupBy(*by, "k").agg(F.avg((F.col(value) < F.col("q")).cast("double")).alias("low"), F.avg((F.col(value) <= F.col("q")).cast("double")).alias("high"))
    wanted = F.element_at(F.array(*[F.lit(x) for x in quantiles]), F.col("k") + 1)
    return near.groupBy(*by).agg(F.max(F.greatest(F.col("low") - wanted, wanted - F.col("high"), F.lit(0.0))).alias("rank_error"))
