"""Tasks that ask a model: opinions, captions, merging of captions, media. Prompts are parameters.

Each is a completion over a column of prompts, so it runs in Python workers with bounded retries; what a
model cannot answer becomes an error mark or null, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import replies, text, urls
from .ledger import Ledger
from .scorers import Completion, complete

QUESTIONS = {
    "sentiment_reply": "Does the writer like or dislike the video? Answer like or dislike.",
    "reason_reply": "Name the main reason for that opinion in a few words.",
    "embodied_reply": "Does the paragraph show learning through body, hands or senses? Begin with yes or no.",
    "logical_reply": "Does the writer reason about what was learned? Begin with yes or no.",
    "logical_embodied_reply": "Is any of that reasoning bound to body, hands or senses? Begin with yes or no.",
}
OTHER = "Name the way of learning that the paragraph shows instead."


def ask_opinions(opinions: DataFrame, model: Completion, questions: dict[str, str] | None = None, other: str = OTHER, tries: int = 3, ledger: Ledger | None = None) -> DataFrame:
    """Five replies for each opinion, and a sixth only where it is liked and not embodied."""
    out = opinions
    for name, question in (questions or QUESTIONS).items():
        out = complete(out.withColumn("_p", F.concat(F.lit(question + "\n\n"), "paragraph")), model, "_p", name, tries, ledger=ledger).drop("_p")
    wanted = (replies.sentiment(F.col("sentiment_reply")) == "like") & ~replies.embodied(F.col("embodied_reply"))["is_embodied"]
    asked = out.where(F.coalesce(wanted, F.lit(False))).withColumn("_p", F.concat(F.lit(other + "\n\n"), "paragraph"))
    rest = out.where(~F.coalesce(wanted, F.lit(False))).withColumn("other_reply", F.lit(None).cast("string"))
    return complete(asked, model, "_p", "other_reply", tries, ledger=ledger).drop("_p").unionByName(rest)


def merge_captions(pairs: DataFrame, model: Completion, prompt: Column, tries: int = 3, ledger: Ledger | None = None) -> DataFrame:
    """One caption of two: what follows ``Final Caption:`` in the reply, else the first one."""
    asked = complete(pairs.withColumn("_p", prompt), model, "_p", "_r", tries, ledger=ledger)
    return asked.withColumn("caption", text.final_caption(F.col("_r"), F.col("caption_a"))).drop("_p", "_r")


def caption_frames(spark: SparkSession, path: str, model: Completion, prompt: str, done: DataFrame | None = None, glob: str = "*.jpg", tries: int = 3, ledger: Ledger | None = None) -> DataFrame:
    """Captions of frames that have none yet: ``video_id``, ``frame``, ``caption``."""
    images = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    rows = images.select(urls.dir_id(F.regexp_replace("path", r"/[^/]*$", "")).alias("video_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("frame"), "content")
    if done is not None:
        rows = rows.join(done.select("video_id", "frame").distinct(), ["video_id", "frame"], "left_anti")
    return complete(rows.withColumn("_p", F.lit(prompt)), model, "_p", "caption", tries, image="content", ledger=ledger).drop("_p", "content")


def captions_document(captions: DataFrame) -> DataFrame:
    """``video_id`` and ``frames`` (id and caption, in order): the shape of the caption files."""
    return captions.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(F.col("frame").alias("frame_id"), "caption"))).alias("frames"))


def probe_files(spark: SparkSession, path: str, probe: Callable[[bytes], float | None], out: str, glob: str = "*") -> DataFrame:
    """A number for each file by a given function (frame rate, duration); null where it fails."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "").alias("video_id"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"video_id": df["video_id"], out: [_try(probe, c) for c in df["content"]]})

    return files.mapInPandas(run, f"video_id string, {out} double")


def transcribe(spark: SparkSession, path: str, recognise: Callable[[bytes], list[tuple[float, float, str]]], glob: str = "*.mp4") -> DataFrame:
    """``video_id`` and ``segments`` of media files by a given recogniser; null segments where it fails."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "").alias("video_id"), "content")
    item = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            found = [_try(recognise, c) for c in df["content"]]
            yield pd.DataFrame({"video_id": df["video_id"], "segments": [None if s is None else [{"start": a, "end": b, "text": t} for a, b, t in s] for s in found]})

    return files.mapInPandas(run, T.StructType([T.StructField("video_id", T.StringType()), T.StructField("segments", T.ArrayType(item))]))


def _try(fn, value):
    try:
        return fn(value)
    except Exception:  # noqa: BLE001 - whatever a probe raises means that it has no answer
        return None


class Streamed:
    """A completion from one that gives its reply in parts: they are joined, an error part ends it."""

    def __init__(self, parts: Callable[[str], Iterator[dict]]):
        self.parts = parts

    def complete(self, prompt: str, image: bytes | None = None) -> str:
        got = []
        for part in self.parts(prompt):
            if "error" in part:
                got.append(f"[Error: {part['error']}]")
                break
            got.append(part.get("content") or "")
        return "".join(got)
