"""Opinions: labels from six replies each, rolled up by video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions import text as X

#: What marks a reply about logical reasoning as a yes, and then one about embodiment.
LOGICAL = ("yes", "student shows", "logical reasoning", "they reasoned", "demonstrates understanding")
EMBODIED = ("yes", "embodied", "hands-on", "physical", "sensor", "motor")


def label(opinions: DataFrame, compat: bool = True) -> DataFrame:
    """Labels from the columns ``sentiment_reply``, ``reason_reply``, ``embodied_reply``, ``logical_reply``, ``logical_embodied_reply`` and ``other_reply`` (null unless liked and not embodied)."""
    e = R.embodied(F.col("embodied_reply"))
    out = opinions.withColumn("sentiment", R.sentiment(F.col("sentiment_reply"), compat)).withColumn("reason", F.lower(X.strip(F.col("reason_reply")))).withColumn("is_embodied", e["is_embodied"]).withColumn("embodied_reason", e["reason"])
    other = X.strip(F.col("other_reply"))
    wanted = (F.col("sentiment") == "like") & ~F.col("is_embodied") & (other != "") & (F.lower(other) != "embodied")
    return out.withColumn("other_paradigm", F.when(wanted, other))


def label_counts(labels: DataFrame) -> DataFrame:
    like, dislike, body = F.col("sentiment") == "like", F.col("sentiment") == "dislike", F.col("is_embodied")
    logical = X.any_keyword(F.col("logical_reply"), LOGICAL)
    return labels.groupBy("link").agg(F.count(F.lit(1)).alias("opinions"), F.count_if(like).alias("like"), F.count_if(dislike).alias("dislike"), F.count_if(like & body).alias("embodied_like"), F.count_if(dislike & body).alias("embodied_dislike"), F.count_if(logical).alias("logical"), F.count_if(logical & X.any_keyword(F.col("logical_embodied_reply"), EMBODIED)).alias("logical_embodied"))


def reason_counts(labels: DataFrame, key: str = "link", reason: str = "reason", order: str = "seq") -> DataFrame:
    """Reasons that are not blank by frequency; equal ones in the order of first appearance.

    The published lists are of ``reason`` among likes and among dislikes, of ``embodied_reason`` among either, and of ``other_paradigm``.
    """
    g = labels.where(F.col("sentiment").isNotNull() & (F.coalesce(reason, F.lit("")) != "")).groupBy(key, reason).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seq"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first_seq")))
