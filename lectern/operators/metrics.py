"""Metrics of videos and of sets of videos.

Means over counts include videos with zero; means over correlation leave out videos without scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

THRESHOLD = 60


def score_stats(candidates: DataFrame, threshold: int = THRESHOLD, key: str = "video_id") -> DataFrame:
    """Mean, median, number and number over the threshold of all scores, whether correlated or not."""
    return candidates.groupBy(key).agg(F.avg("score").alias("corr_avg"), F.median("score").alias("corr_median"), F.count("score").alias("corr_n"), F.count_if(F.col("score") >= threshold).alias("corr_n_over"))


def distinct_comments(candidates: DataFrame, key: str = "video_id") -> DataFrame:
    """Different trimmed comments; blank ones don't count."""
    return candidates.groupBy(key).agg(F.countDistinct(F.nullif(X.strip(F.col("comment")), F.lit(""))).alias("comments"))


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"))


def transcript_words(texts: DataFrame, docs: DataFrame, compat: bool = True) -> DataFrame:
    """Words of the text file if there is one, header lines included as published (``compat=False``: the body), else of the segments."""
    own = texts.select(F.col("file").alias("video_id"), X.word_count(F.concat_ws("\n", "title", "url", "category", "body") if compat else F.col("body")).alias("txt_words"))
    seg = docs.select("video_id", F.aggregate(F.coalesce("segments", F.array()), F.lit(0).cast("long"), lambda a, s: a + X.word_count(s["text"])).alias("json_words"))
    return own.join(seg, "video_id", "full").select("video_id", F.coalesce("txt_words", "json_words", F.lit(0)).alias("transcript_words"))


def topic_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("video_id").agg(F.max(F.greatest(F.coalesce(F.size("topics"), F.lit(0)), F.lit(0))).cast("long").alias("topics"))


def video_metrics(videos: DataFrame, *parts: DataFrame) -> DataFrame:
    """The ids with every part joined to them; counts that are missing are 0, the rest null."""
    out = videos.select("video_id").distinct()
    for p in parts:
        out = out.join(p, "video_id", "left")
    counts = [c for c in ("frames", "transcript_words", "topics", "comments", "corr_n", "corr_n_over") if c in out.columns]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def last_row_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key that is not null: the last."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def with_extra(metrics: DataFrame, extra: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Requested columns of an external table that the metrics don't have, in the order asked for."""
    wanted = [c for c in dict.fromkeys(columns) if c not in metrics.columns and c in extra.columns]
    return metrics.join(last_row_wins(extra.select("video_id", order, *wanted), "video_id", order), "video_id", "left")


def set_aggregate(metrics: DataFrame, label: str) -> DataFrame:
    return metrics.agg(
        F.lit(label).alias("label"), F.count(F.lit(1)).alias("num_videos"), F.avg("frames").alias("avg_frames"), F.avg("transcript_words").alias("avg_transcript_words"),
        F.avg("topics").alias("avg_topics"), F.avg("comments").alias("avg_comments"), F.avg("corr_avg").alias("avg_corr_avg"), F.median("corr_avg").alias("median_corr_avg"),
    )
