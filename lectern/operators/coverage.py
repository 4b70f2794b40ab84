"""Reports over scored candidates: coverage of comments, ranking of units, kept comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SCORE, TOP_K = 60, 5


def passes(min_score: int = MIN_SCORE) -> Column:
    """The candidate is correlated and reaches the score."""
    return F.coalesce(F.col("correlated") & (F.col("score") >= min_score), F.lit(False))


def coverage(candidates: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Per (url, comment): units matched, the best passing score (0 if none) and the score and reason by unit.

    A candidate repeated for a unit counts once, the last one.
    """
    keys = ["video_id", "url", "comment", "unit_id"]
    last = candidates.groupBy(*keys).agg(F.max_by(F.struct("correlated", "score", "reason"), "cand_idx").alias("r")).select(*keys, "r.*")
    own = F.when(passes(min_score), F.struct(F.col("unit_id").alias("key"), F.struct("score", "reason").alias("value")))
    return last.groupBy("video_id", "url", "comment").agg(F.count(F.when(passes(min_score), 1)).alias("n_units"), F.coalesce(F.max(F.when(passes(min_score), F.col("score"))), F.lit(0)).alias("max_score"), F.map_from_entries(F.sort_array(F.collect_list(own))).alias("per_unit"))


def coverage_order() -> list[Column]:
    return [F.desc("n_units"), F.desc("max_score"), F.desc("comment")]


def coverage_summary(covered: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """Comments with a match, and their percentage of the available ones (null where that number is not known)."""
    g = covered.groupBy("video_id").agg(F.count_if(F.col("n_units") > 0).alias("n_correlated"))
    if available is None:
        return g.withColumn("percent", F.lit(None).cast("double"))
    n = available.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_available"))
    return g.join(n, "video_id", "left").withColumn("percent", F.try_divide(100.0 * F.col("n_correlated"), F.col("n_available").cast("double")))


def total_pairs(records: DataFrame) -> DataFrame:
    """Pairs checked, over all cached records, whether their unit still exists or not."""
    return records.groupBy("video_id").agg(F.coalesce(F.sum("checked_pairs"), F.lit(0)).alias("total_pairs"))


def unit_ranking(units: DataFrame, candidates: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Mean passing score (0.0 if none) and the number of passing candidates of every unit."""
    g = candidates.where(passes(min_score)).groupBy("video_id", "unit_id").agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("contributions"))
    return units.select("video_id", "unit_id", "title").join(g, ["video_id", "unit_id"], "left").select("video_id", "unit_id", "title", F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"), F.coalesce("contributions", F.lit(0)).alias("contributions"))


def top_bottom(rows: DataFrame, keys: list[str], by: list[str], n: int) -> DataFrame:
    """The first and last ``n`` of each key by the columns, descending and ascending; a row may be in both."""
    desc = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by])
    asc = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("rank", F.row_number().over(desc)).where(F.col("rank") <= n).withColumn("side", F.lit("top")).unionByName(rows.withColumn("rank", F.row_number().over(asc)).where(F.col("rank") <= n).withColumn("side", F.lit("bottom")))


def top_units(ranking: DataFrame, n: int = 3) -> DataFrame:
    return top_bottom(ranking, ["video_id"], ["avg_score", "title", "unit_id"], n)


def units_per_comment(covered: DataFrame, n: int = 10) -> DataFrame:
    """The strongest and weakest units of each comment."""
    rows = covered.select("video_id", "url", "comment", F.explode("per_unit").alias("unit_id", "v")).select("video_id", "url", "comment", "unit_id", "v.score", "v.reason")
    return top_bottom(rows, ["video_id", "url", "comment"], ["score", "unit_id"], n)


def kept_comments(candidates: DataFrame, min_score: int = MIN_SCORE, k: int = TOP_K) -> DataFrame:
    """The best ``k`` passing candidates of each unit; equal scores keep their order."""
    w = Window.partitionBy("video_id", "unit_id").orderBy(F.desc("score"), "cand_idx")
    return candidates.where(passes(min_score)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
