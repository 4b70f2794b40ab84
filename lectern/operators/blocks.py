"""Blocks of paragraphs: a heading row opens one, the rows up to the next belong to it.

All are running windows over the paragraphs of a document, one shuffle by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls
from ..functions.vectors import join_ordered


def islands(rows: DataFrame, is_head: Column, keys: list[str], order: str, name: str = "block") -> DataFrame:
    """Number the blocks: 0 before the first heading, then 1, 2, ..."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_head", F.coalesce(is_head, F.lit(False))).withColumn(name, F.sum(F.col("_head").cast("int")).over(w))


def comments(paragraphs: DataFrame) -> DataFrame:
    """A paragraph with a video address opens a block; all that follow are **one** comment, joined by blanks.

    Text before the first address is dropped, as are blocks without text. ``video_id``, ``comment_idx``, ``url`` (the whole heading), ``comment``.
    """
    rows = paragraphs.where(X.strip(F.col("text")) != "").withColumn("text", X.strip(F.col("text"))).withColumn("_id", urls.video_id(F.col("text")))
    rows = islands(rows, F.col("_id").isNotNull(), ["doc"], "para_no").where("block > 0")
    g = rows.groupBy("doc", "block").agg(F.max(F.when(F.col("_head"), F.col("_id"))).alias("_id"), F.max(F.when(F.col("_head"), F.col("text"))).alias("url"), join_ordered(F.collect_list(F.when(~F.col("_head"), F.struct(F.col("para_no").alias("p"), F.col("text").alias("text"))))).alias("comment"))
    return g.where("comment <> ''").select("doc", F.col("block").alias("comment_idx"), urls.clean_id(F.col("_id")).alias("video_id"), "url", "comment")


def opinions(paragraphs: DataFrame) -> DataFrame:
    """A paragraph with a watch link sets the video; each following paragraph is an opinion of its **own**."""
    link = F.nullif(F.regexp_extract("text", r"(?U)https://www\.youtube\.com/watch\?v=[\w-]+", 0), F.lit(""))
    w = Window.partitionBy("doc").orderBy("para_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = paragraphs.withColumn("_link", link).withColumn("link", F.last("_link", ignorenulls=True).over(w))
    return rows.where(F.col("_link").isNull() & F.col("link").isNotNull() & (X.strip(F.col("text")) != "")).select("doc", "link", F.col("para_no").alias("seq"), X.strip(F.col("text")).alias("paragraph"))


def links(paragraphs: DataFrame) -> DataFrame:
    """All video links in order, repeats kept."""
    return paragraphs.select("doc", "para_no", F.posexplode(urls.links(F.col("text"))).alias("k", "link"))


#: How frames are headed in documents.
FRAME_HEAD = r"(?i)^\s*frame:\s*(.*?)\s*$"
IMAGE_HEAD = r"^\s*(?:Frame: )?(frame_\d{4}\.jpg)"


def captions(paragraphs: DataFrame) -> DataFrame:
    """``Frame: name`` opens a frame; its paragraphs are joined by blanks."""
    rows = islands(paragraphs, F.col("text").rlike(FRAME_HEAD), ["doc"], "para_no").where("block > 0")
    body = F.collect_list(F.when(~F.col("_head") & (X.strip(F.col("text")) != ""), F.struct(F.col("para_no").alias("p"), X.strip(F.col("text")).alias("text"))))
    return rows.groupBy("doc", "block").agg(F.max(F.when(F.col("_head"), F.regexp_extract("text", FRAME_HEAD, 1))).alias("frame"), join_ordered(body).alias("caption"))


def caption_map(paragraphs: DataFrame, compat: bool = True) -> DataFrame:
    """A frame's name opens its text; a repeated name starts anew, so the last wins.

    As published each text begins with a blank; ``compat=False`` leaves it out.
    """
    rows = islands(paragraphs, F.col("text").rlike(IMAGE_HEAD), ["doc"], "para_no").where("block > 0")
    body = F.collect_list(F.when(~F.col("_head") & (X.strip(F.col("text")) != ""), F.struct(F.col("para_no").alias("p"), X.strip(F.col("text")).alias("text"))))
    g = rows.groupBy("doc", "block").agg(F.max(F.when(F.col("_head"), F.regexp_extract("text", IMAGE_HEAD, 1))).alias("frame"), join_ordered(body).alias("caption"))
    g = g.withColumn("caption", F.when(F.col("caption") != "", F.concat(F.lit(" " if compat else ""), F.col("caption"))).otherwise(F.lit("")))
    return g.groupBy("doc", "frame").agg(F.max_by("caption", "block").alias("caption"))


def processed_frames(paragraphs: DataFrame, validate: int = 0) -> DataFrame:
    """Frames that a document has already, by its first-level headings, lower-cased.

    With ``validate`` any such heading is a frame, but only with a description and a caption in so many next rows.
    """
    t = X.strip(F.col("text"))
    top = F.col("style").rlike(r"^Heading ?1")
    if not validate:
        name = F.regexp_extract(t, r"(?i)^(?:Frame: )?(frame_\d{4}\.jpg)", 1)
        return paragraphs.where(top & (name != "")).select("doc", F.lower(name).alias("frame")).distinct()
    w = Window.partitionBy("doc").orderBy("para_no").rowsBetween(1, validate)
    both = [F.max(F.startswith(t, F.lit(k))).over(w) for k in ("Description:", "Caption:")]
    named = F.when(F.lower(t).startswith("frame:") & F.contains(t, F.lit("Frame:")), X.strip(F.regexp_replace(t, r"(?s)^.*?Frame:", ""))).otherwise(t)
    return paragraphs.withColumn("_ok", F.coalesce(both[0] & both[1], F.lit(False))).where(top & F.col("_ok")).select("doc", F.lower(named).alias("frame")).distinct()
