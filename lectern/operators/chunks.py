"""Chunking, thinning and numbering of ordered segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.times import hms

STATE = "struct<n:int,first:double,chars:bigint,breaks:array<int>>"


def chunk_segments(segments: DataFrame, max_seconds: float = 900.0, max_chars: int = 12000) -> DataFrame:
    """Greedy chunks of a video's segments, in order.

    A chunk closes before a segment that would end more than ``max_seconds`` after the chunk's start or
    bring the characters of its lines (with both times) over ``max_chars``. A segment beyond either limit
    alone is a chunk of its own. One fold over a video's ordered segments; returns the segments with
    ``line`` and ``chunk_index``.
    """
    line_of = F.format_string("[%s → %s] %s\n", hms(F.col("start")), hms(F.col("end")), X.strip(F.col("text")))
    item = F.struct("seg_idx", "start", "end", "text", line_of.alias("line"))
    g = segments.groupBy("video_id").agg(F.sort_array(F.collect_list(item)).alias("s"))

    def step(a, x):
        line = F.length(x["line"]).cast("bigint")
        opens = (a["n"] == 0) | (x["end"] - a["first"] > F.lit(float(max_seconds))) | (a["chars"] + line > F.lit(max_chars))
        return F.struct((a["n"] + 1).alias("n"), F.when(opens, x["start"]).otherwise(a["first"]).alias("first"), F.when(opens, line).otherwise(a["chars"] + line).alias("chars"), F.when(opens, F.concat(a["breaks"], F.array(a["n"]))).otherwise(a["breaks"]).alias("breaks"))

    seed = F.from_json(F.lit('{"n":0,"first":0.0,"chars":0,"breaks":[]}'), STATE)
    g = g.withColumn("breaks", F.aggregate("s", seed, step)["breaks"])
    # only the chunks' first positions are kept by the fold; each chunk is a slice
    until = F.coalesce(F.get("breaks", F.col("chunk_index") + 1), F.size("s"))
    g = g.select("video_id", "s", "breaks", F.posexplode("breaks").alias("chunk_index", "at"))
    return g.select("video_id", "chunk_index", F.explode(F.slice("s", F.col("at") + 1, until - F.col("at"))).alias("z")).select("video_id", "z.seg_idx", "z.start", "z.end", "z.text", "z.line", "chunk_index")


def chunk_texts(chunked: DataFrame) -> DataFrame:
    """``chunk_index``, ``start``, ``end``, ``n`` and the lines of each chunk, with absolute times."""
    g = chunked.groupBy("video_id", "chunk_index").agg(F.min_by("start", "seg_idx").alias("start"), F.max_by("end", "seg_idx").alias("end"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("seg_idx", "line"))).alias("l"))
    return g.select("video_id", "chunk_index", "start", "end", "n", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("text"))


def number_segments(segments: DataFrame) -> DataFrame:
    """Lines ``[S00000] text``."""
    return segments.withColumn("line", F.format_string("[S%05d] %s", F.col("seg_idx"), X.strip(F.col("text"))))


def thin_lines(rows: DataFrame, budget: int, numbered: bool = False, key: str = "video_id", idx: str = "seg_idx", line: str = "line") -> DataFrame:
    """Keep every ``step``-th line so that a key's lines, joined by newlines, fit ``budget`` characters.

    The step starts at max(2, total / budget) and grows until the lines fit or its cap is reached; the cap
    is the number of lines, or with ``numbered`` max(3, half of it), so the result may still be too long.
    Lines that fit without the blank ones stay, without them.
    """
    w = Window.partitionBy(key)
    blank = X.strip(F.col(line)) == ""
    lines = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(idx)) - 1).withColumn("_len", F.length(line) + 1).withColumn("_total", F.coalesce(F.sum(F.when(~blank, F.col("_len"))).over(w), F.lit(1)) - 1).withColumn("_count", F.count(F.lit(1)).over(w))
    cap = F.greatest(F.lit(3), (F.col("_count") / 2).cast("int")) if numbered else F.col("_count").cast("int")
    first = F.greatest(F.lit(2), (F.col("_total") / F.lit(budget)).cast("int"))
    # lengths at every step from the first on: only texts over the budget are folded
    g = lines.where(F.col("_total") > budget).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", "_len"))).alias("l"), F.first(first).alias("first"), F.first(cap).alias("cap"))
    fits = lambda s: F.aggregate(F.filter("l", lambda x: x["_n"] % s == 0), F.lit(-1).cast("bigint"), lambda a, x: a + x["_len"]) <= budget
    steps = F.sequence("first", F.greatest("first", "cap"))
    chosen = g.select(key, F.coalesce(F.get(F.filter(steps, fits), F.lit(0)), F.greatest("first", "cap")).alias("step"))
    out = lines.join(chosen, key, "left")
    return out.where(F.when(F.col("step").isNull(), ~blank).otherwise(F.col("_n") % F.col("step") == 0)).drop("_n", "_len", "_total", "_count")


def sample_frames(frames: DataFrame, every: int = 100) -> DataFrame:
    """Every ``every``-th decoded frame, renumbered and named."""
    kept = frames.where(F.col("frame_no") % every == 0).withColumn("saved_idx", (F.col("frame_no") / every).cast("int"))
    return kept.withColumn("frame", F.format_string("frame_%04d.jpg", "saved_idx"))
