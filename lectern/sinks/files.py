"""Outputs by video. Texts are built as columns; one row is one file's content."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import hms, srt
from ..session import discard_folder, work_dir
from . import committed


def ordered_lines(segments: DataFrame, line: Column, glue: str = "\n", key: str = "video_id", order: str = "seg_idx") -> DataFrame:
    """``key`` and the lines of its rows joined in order."""
    g = segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))).alias("l"))
    return g.select(key, F.array_join(F.transform("l", lambda x: x["line"]), glue).alias("text"))


def plain_txt(docs: DataFrame) -> DataFrame:
    """Title, address, category and the text of the segments."""
    body = F.array_join(F.transform("segments", lambda s: F.trim(F.coalesce(s["text"], F.lit("")))), " ")
    return docs.select("video_id", F.concat_ws("\n", *[F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "url", "category")], F.trim(body)).alias("text"))


def timestamped_txt(segments: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """A line for each segment; with ``docs`` below title, address, category and a blank line."""
    rows = ordered_lines(segments, F.format_string("[%s → %s] %s\n", hms(F.col("start")), hms(F.col("end")), F.trim("text")), "")
    if docs is None:
        return rows
    head = docs.select("video_id", F.concat_ws("\n", *[F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "url", "category")], F.lit("\n")).alias("_head"))
    return rows.join(head, "video_id").select("video_id", F.concat("_head", "text").alias("text"))


def srt_cue() -> Column:
    return F.format_string("%d\n%s --> %s\n%s\n\n", F.col("seg_idx") + 1, srt(F.col("start")), srt(F.col("end")), F.trim("text"))


def srt_txt(segments: DataFrame) -> DataFrame:
    return ordered_lines(segments, srt_cue(), "")


def pretty_json(rows: DataFrame, key: str = "video_id") -> DataFrame:
    """One indented document for each row."""
    return rows.select(key, F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("text"))


def write_texts(rows: DataFrame, path: str, key: str = "video_id") -> None:
    """Texts in a folder for each video; ``write_named`` gives them names instead."""
    rows.select(F.col(key), F.col("text")).write.mode("overwrite").partitionBy(key).text(path)


def write_named(rows: DataFrame, path: str, name: str = "name", content: str = "text") -> int:
    """A file for each row, under its own name (which may have folders); null is an empty file. Returns how many.

    Files are written where the rows are, and appear when all are written; neither contents nor names pass the driver (``committed.write``).
    """
    return committed.write(rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")), path, uuid.uuid4().hex)


def write_frames(frames: DataFrame, path: str) -> int:
    """Encoded images under ``<video>/raw_frames/frame_NNNN.jpg``; decoding and encoding are the caller's."""
    name = F.concat("video_id", F.lit("/raw_frames/"), F.format_string("frame_%04d.jpg", "saved_idx"))
    return write_named(frames.select(name.alias("name"), "content"), path, content="content")


def sync_files(spark, source: str, target: str, glob: str = "*") -> int:
    """Copy the files of a folder that another lacks or holds in another length; folders below are kept. Returns how many."""
    own = lambda home: spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(home).select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length", "content")
    below = lambda df, home: df.withColumn("name", F.substring_index("path", re.sub("^file:/+", "/", home.rstrip("/")) + "/", -1))
    there = below(own(target), target).select("name", "length")
    return write_named(below(own(source), source).join(there, ["name", "length"], "left_anti").select("name", "content"), target, content="content")


def append_json(rows: DataFrame, path: str) -> None:
    """Append records as JSON lines; finished units stay whatever happens later."""
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A CSV with a header; null is the empty text."""
    rows.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_lines(rows: DataFrame, column: str, path: str, bucket: str | None = None) -> None:
    """A file of lines, or one folder for each bucket."""
    out = rows.select(F.col(column).cast("string").alias("value"), *([bucket] if bucket else []))
    (out.write.partitionBy(bucket) if bucket else out.write).mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Download outcomes, a row for each attempt."""
    rows.select("url", "video_id", "outcome").write.mode("append").json(path)


def video_csv(videos: DataFrame) -> DataFrame:
    """``index``, ``url``, ``title`` (without commas), ``category``, ``relevant``."""
    return videos.select(F.col("seq").alias("index"), "url", F.replace(F.col("title"), F.lit(","), F.lit("")).alias("title"), "category", "relevant")


def metrics_json(metrics: DataFrame, aggregate: DataFrame) -> DataFrame:
    """One document: the aggregate and the videos by id."""
    rows = metrics.agg(F.sort_array(F.collect_list(F.struct("video_id", F.struct(*[c for c in metrics.columns if c != "video_id"]).alias("m")))).alias("videos"))
    return rows.crossJoin(aggregate.select(F.struct("*").alias("aggregate"))).select(F.to_json(F.struct("aggregate", "videos"), {"pretty": "true", "ignoreNullFields": "false"}).alias("text"))


def write_metrics(metrics: DataFrame, aggregate: DataFrame, path: str) -> None:
    """The document of ``metrics_json`` as a file with a line for each video, in order, written by many tasks and read by as many (``sources.files.metrics_document``)."""
    spark, parts = metrics.sparkSession, work_dir(metrics.sparkSession)
    whole = {"ignoreNullFields": "false"}
    video = F.to_json(F.struct("video_id", F.struct(*[c for c in metrics.columns if c != "video_id"]).alias("m")), whole)
    metrics.orderBy("video_id").select(F.concat(video, F.lit(",")).alias("value")).write.text(parts)
    head = aggregate.select(F.to_json(F.struct("*"), whole)).first()[0]  # one row
    committed.join_files(spark, parts, path, f'{{"aggregate": {head}, "videos": [\n'.encode(), b"\n]}\n", len(",\n"))
    discard_folder(spark, parts)
