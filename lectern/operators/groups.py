"""Sliding frame groups, representative picks, combined captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.vectors import evenly


def frame_groups(captions: DataFrame, size: int = 3, stride: int = 1, key: str = "video_id") -> DataFrame:
    """Full windows of ``size`` frames every ``stride``: ``group_id``, ``frames``, ``captions``, ``combined_caption``."""
    order = Window.partitionBy(key).orderBy("frame")
    item = F.struct("frame", F.coalesce("caption", F.lit("")).alias("caption"))
    w = captions.withColumn("_n", F.row_number().over(order) - 1).withColumn("_g", F.collect_list(item).over(order.rowsBetween(0, size - 1)))
    w = w.where((F.size("_g") == size) & (F.col("_n") % stride == 0))
    names, texts = F.transform("_g", lambda x: x["frame"]), F.transform("_g", lambda x: x["caption"])
    return w.select(key, F.col("_n").alias("first"), F.array_join(names, "+").alias("group_id"), names.alias("frames"), texts.alias("captions"), combined_caption(F.col("_g")).alias("combined_caption"))


def combined_caption(group: Column) -> Column:
    """Lines ``Frame j (name): caption``, from 1."""
    return F.array_join(F.transform(group, lambda x, j: strip(F.concat(F.lit("Frame "), (j + 1).cast("string"), F.lit(" ("), x["frame"], F.lit("): "), x["caption"]))), "\n")


def representatives(frames: Column, k: int) -> Column:
    """``k`` evenly spaced elements of an array, all if it has no more."""
    return F.transform(evenly(F.size(frames), k), lambda i: F.get(frames, i))


def merge_captions(first: DataFrame, second: DataFrame, on_disk: DataFrame, done: DataFrame) -> DataFrame:
    """Frames with both captions that are on disk and not done yet."""
    keys = ["video_id", "frame"]
    both = first.select(*keys, F.col("caption").alias("caption_a")).join(second.select(*keys, F.col("caption").alias("caption_b")), keys)
    return both.join(on_disk.select(*keys).distinct(), keys, "left_semi").join(done.select(*keys).distinct(), keys, "left_anti")
