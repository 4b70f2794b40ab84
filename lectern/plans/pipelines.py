"""The workflows end to end: correlation, topics, metrics, opinions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..models import scorers
from ..models.ledger import Ledger
from ..operators import chunks, coverage, intervals, metrics, opinions, retrieval
from ..session import written


def correlate(videos: DataFrame, topics: DataFrame, comments: DataFrame, results: DataFrame | None = None, k: int = 50, min_score: int = 60) -> DataFrame:
    """Candidates for topics without results: comments of the video or all, the ``k`` most similar, scored by words.

    ``topics`` has ``video_id``, ``unit_id``, ``title``, ``description``; ``comments`` ``video_id``, ``comment_idx``, ``comment``, ``url``.
    """
    todo = topics if results is None else retrieval.unfinished(topics, results)
    units = todo.withColumn("unit_text", X.topic_text(F.col("title"), F.col("description")))
    # each text is embedded once, before videos without comments get them all; texts are joined to what is found
    unit_vecs = written(scorers.embed(units.select("video_id", "unit_id", "unit_text"), "unit_text", "unit_vec").drop("unit_text"))
    own = comments.select("video_id", F.struct("video_id", "comment_idx").alias("_at"), "comment")
    available = retrieval.comments_of(videos, written(scorers.embed(own, "comment", "comment_vec").drop("comment")))
    found = retrieval.top_k(unit_vecs, available, k, idx="_at")
    texts = comments.select(F.struct("video_id", "comment_idx").alias("_at"), *[c for c in comments.columns if c != "video_id"])
    found = found.drop("unit_vec", "comment_vec").join(units, ["video_id", "unit_id"]).join(texts, "_at").drop("_at")
    scored = scorers.score_lexically(found, "unit_text", "comment", min_score)
    return scored.withColumn("cand_idx", F.col("rank") - 1 if k else F.col("comment_idx"))


def result_records(candidates: DataFrame) -> DataFrame:
    """One record for each unit, its candidates in order."""
    item = F.struct("cand_idx", "correlated", "score", "reason", "comment", "url")
    return candidates.groupBy("video_id", "unit_id", "title").agg(F.count(F.lit(1)).alias("checked_pairs"), F.sort_array(F.collect_list(item)).alias("candidates"))


def correlation_summary(topics: DataFrame, candidates: DataFrame, min_score: int = 60) -> DataFrame:
    return coverage.top_units(coverage.unit_ranking(topics, candidates, min_score))


def topics_by_chunk(segments: DataFrame, model: scorers.Completion, prompt: str, max_seconds: float = 900.0, max_chars: int = 12000, tries: int = 3, ledger: Ledger | None = None) -> DataFrame:
    """Topics of a transcript: chunks, a reply for each, times made absolute, topics consolidated.

    A video of which any chunk fails has no topics; its errors are in ``failures``. Calls go through a ledger: a
    given one is for runs to come, else one of this session, so that each is made once.
    """
    texts = chunks.chunk_texts(chunks.chunk_segments(segments, max_seconds, max_chars))
    asked = scorers.extract_with_retries(texts.withColumn("prompt", F.concat(F.lit(prompt), F.lit("\n"), "text")), model, "prompt", tries, ledger=ledger or Ledger(segments.sparkSession))
    bad = failures(asked).select("video_id").distinct()
    rows = asked.join(bad, "video_id", "left_anti").select("video_id", F.col("start").alias("chunk_start"), F.explode("extracted.parsed").alias("t")).select("video_id", "chunk_start", "t.*")
    return intervals.consolidate_topics(intervals.shift_to_absolute(rows))


def failures(asked: DataFrame) -> DataFrame:
    return asked.where(F.col("extracted.parsed").isNull()).select("video_id", "chunk_index", "extracted.error", "extracted.attempts")


def whole_topics(docs: DataFrame, model: scorers.Completion, simple_prompt: str, timed_prompt: str, chunk_prompt: str, segments: DataFrame, budget: int = 80000, ledger: Ledger | None = None) -> DataFrame:
    """The cascade: the whole transcript by numbered lines, then by timestamps, then by chunks. Each call is made once."""
    ledger = ledger or Ledger(docs.sparkSession)
    numbered = chunks.thin_lines(chunks.number_segments(segments), budget, numbered=True)
    timed = chunks.thin_lines(segments.withColumn("line", F.concat(F.col("start").cast("string"), F.lit(" "), "text")), budget)

    def ask(lines: DataFrame, prompt: str, mode: str):
        def stage(rest: DataFrame) -> DataFrame:
            own = lines.join(rest.select("video_id"), "video_id", "left_semi").groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", "line"))).alias("l"))
            text = own.select("video_id", F.concat(F.lit(prompt + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("prompt"))
            got = scorers.extract_with_retries(text, model, "prompt", mode=mode, ledger=ledger)
            return got.select("video_id", F.col("extracted.parsed").alias("topics"))

        return stage

    def by_chunk(rest: DataFrame) -> DataFrame:
        found = topics_by_chunk(segments.join(rest.select("video_id"), "video_id", "left_semi"), model, chunk_prompt, ledger=ledger)
        return found.groupBy("video_id").agg(F.collect_list(F.struct("title", "description", "evidence_quotes", "start_s", "end_s", F.lit(None).cast("array<struct<start_idx:int,end_idx:int>>").alias("coverage"))).alias("topics"))

    return scorers.cascade(docs.select("video_id"), ("whole_simple", ask(numbered, simple_prompt, "simple")), ("whole_timestamped", ask(timed, timed_prompt, "whole")), ("chunked", by_chunk))


def set_metrics(videos: DataFrame, frames: DataFrame, words: DataFrame, topics: DataFrame, candidates: DataFrame, label: str, threshold: int = 60) -> tuple[DataFrame, DataFrame]:
    """Metrics by video and their aggregate."""
    per = metrics.video_metrics(videos, metrics.frame_counts(frames), words, topics, metrics.distinct_comments(candidates), metrics.score_stats(candidates, threshold))
    return per, metrics.set_aggregate(per, label)


def opinion_rollup(replies: DataFrame, compat: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, counts and reasons by video."""
    labels = opinions.label(replies, compat)
    return labels, opinions.label_counts(labels), opinions.reason_counts(labels)
