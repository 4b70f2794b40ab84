"""Merging of intervals and ranges, consolidation of topics, lookups by range."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str, slack: float = 0.0, extra: list | None = None) -> DataFrame:
    """Unite the intervals of a key that begin at most ``slack`` after the furthest end before them."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_far", F.max(end).over(before)).withColumn("_new", (F.col("_far").isNull() | (F.col(start) > F.col("_far") + slack)).cast("int"))
    marked = marked.withColumn("island", F.sum("_new").over(upto))
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"), *(extra or []))


def merge_ranges(rows: DataFrame, keys: list[str], low: str = "start_idx", high: str = "end_idx", size: str | None = None) -> DataFrame:
    """Index ranges, ends included: bounds swapped where reversed, clamped to the size, touching ones united."""
    a, b = F.least(low, high), F.greatest(low, high)
    if size:
        a, b = (F.greatest(F.lit(0), F.least(x, F.col(size) - 1)) for x in (a, b))
    return merge_intervals(rows.withColumns({low: a, high: b}), keys, low, high, 1)


def consolidate_topics(topics: DataFrame, slack: float = 2.0, most: int = 12) -> DataFrame:
    """Unite topics of one title that overlap or nearly do, then shrink to ``most`` and name them ``T1``, ``T2``, ...

    Order is by lower-cased title, then start: ids and the left neighbour follow it, not time. While there
    are too many, the shortest is absorbed: its left neighbour takes over its end, or, if it is the first,
    its right one its start. Quotes are the first three of what was united, titles those of the earliest.
    """
    keyed = topics.withColumn("_key", F.lower(F.trim("title")))
    quotes = F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start_s", "end_s", "evidence_quotes"))), lambda x: x["evidence_quotes"])), 1, 3)
    first = lambda c: F.min_by(c, F.struct("start_s", "end_s")).alias(c)
    merged = merge_intervals(keyed, ["video_id", "_key"], "start_s", "end_s", slack, [first("title"), first("description"), quotes.alias("evidence_quotes")])
    item = F.struct("_key", "start_s", "end_s", "title", "description", "evidence_quotes")
    g = merged.groupBy("video_id").agg(F.sort_array(F.collect_list(item)).alias("t"))

    schema = g.schema

    def shrink(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _shrunk(batch.column(1), most)], names=schema.fieldNames())

    g = g.mapInArrow(shrink, schema)
    return g.select("video_id", F.posexplode("t").alias("pos", "x")).select("video_id", F.concat(F.lit("T"), F.col("pos") + 1).alias("topic_id"), "x.title", "x.description", "x.evidence_quotes", "x.start_s", "x.end_s")


def absorb_shortest(start: list[float], end: list[float], most: int) -> list[int]:
    """Rows that stay when the shortest is absorbed until ``most`` are left; ``start`` and ``end`` are changed in place.

    A heap gives the shortest, the first of several; a linked list its neighbours. An entry whose row has changed since is stale.
    """
    n = len(start)
    left, right, there = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(e - s, k) for k, (s, e) in enumerate(zip(start, end))]
    heapify(heap)
    for _ in range(n - max(most, 1)):
        while True:
            span, k = heappop(heap)
            if there[k] and span == end[k] - start[k]:
                break
        there[k] = False
        if left[k] < 0:
            to = right[k]
            start[to] = min(start[k], start[to])
        else:
            to = left[k]
            end[to] = max(end[k], end[to])
        if left[k] >= 0:
            right[left[k]] = right[k]
        if right[k] < n:
            left[right[k]] = left[k]
        heappush(heap, (end[to] - start[to], to))
    return [k for k in range(n) if there[k]]


def _shrunk(lists: pa.ListArray, most: int) -> pa.ListArray:
    """Lists of topics with no more than ``most`` each; only longer ones are looked at one by one."""
    flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    names = [f.name for f in flat.type]
    bounds = {c: flat.field(c).to_numpy(zero_copy_only=False).copy() for c in ("start_s", "end_s")}
    keep = np.ones(len(flat), bool)
    for k in np.flatnonzero(np.diff(offsets) > most):
        a, b = offsets[k], offsets[k + 1]
        start, end = bounds["start_s"][a:b].tolist(), bounds["end_s"][a:b].tolist()
        stay = absorb_shortest(start, end, most)
        keep[a:b] = False
        keep[a + np.array(stay)] = True
        bounds["start_s"][a:b], bounds["end_s"][a:b] = start, end
    rows = pa.array(np.flatnonzero(keep))
    made = pa.StructArray.from_arrays([(pa.array(bounds[c], flat.field(c).type) if c in bounds else flat.field(c)).take(rows) for c in names], fields=list(flat.type))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)])[offsets], pa.int32()), made).cast(lists.type)


def shift_to_absolute(topics: DataFrame, compat: bool = True) -> DataFrame:
    """Add the chunk's start to local times.

    As published the chunk's text already shows absolute times, so what a model copies is shifted twice;
    ``compat=False`` shifts only times that begin before the chunk.
    """
    shift = F.col("chunk_start") if compat else F.when(F.col("start_s") < F.col("chunk_start"), F.col("chunk_start")).otherwise(F.lit(0.0))
    return topics.withColumns({"start_s": F.col("start_s") + shift, "end_s": F.col("end_s") + shift})


def covered_segments(ranges: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of index ranges: each range becomes its indices, which join by equality."""
    idx = ranges.select(*keys, F.explode(F.sequence("start_idx", "end_idx")).alias("seg_idx")).distinct()
    return idx.join(segments, ["video_id", "seg_idx"])


def range_times(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """The start of a range's first segment and the end of its last, where that is later."""
    a = segments.select("video_id", F.col("seg_idx").alias("start_idx"), F.col("start").alias("start_s"))
    b = segments.select("video_id", F.col("seg_idx").alias("end_idx"), F.col("end").alias("end_s"))
    return ranges.join(a, ["video_id", "start_idx"], "left").join(b, ["video_id", "end_idx"], "left").where("end_s > start_s")


def coverage_of(ranges: DataFrame, segments: DataFrame, keys: list[str], most: int = 8000) -> DataFrame:
    """Indices, times and text (cut at ``most`` characters) of merged ranges, by ``keys`` (``video_id`` among them)."""
    size = segments.groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("_size"))
    merged = merge_ranges(ranges.join(size, "video_id"), keys, size="_size").select(*keys, "start_idx", "end_idx")
    spans = range_times(merged, segments).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_idx", "start_s", "end_s"))).alias("t"))
    texts = covered_segments(merged, segments, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seg_idx", X.strip(F.col("text")).alias("text")))).alias("s"))
    whole = F.array_join(F.filter(F.transform("s", lambda x: x["text"]), lambda x: x != ""), "\n")
    out = texts.join(spans, keys, "left")
    return out.select(*keys, F.transform("s", lambda x: x["seg_idx"]).alias("coverage_segments"), F.transform("t", lambda x: F.struct(x["start_s"].alias("start_s"), x["end_s"].alias("end_s"))).alias("coverage_times"), X.truncate(whole, most).alias("coverage_text"))


def prefix_lookup(ids: DataFrame, files: DataFrame, compat: bool = True) -> DataFrame:
    """The file of each id: the first whose name begins with it, or with ``compat=False`` whose stem equals it.

    Names are joined by their beginnings of each length that an id has, so the join has a key; the different lengths are a few numbers.
    """
    if not compat:
        return ids.join(files.select(F.col("stem").alias("video_id"), "name"), "video_id", "left").groupBy("video_id").agg(F.min("name").alias("name"))
    sizes = ids.agg(F.collect_set(F.length("video_id"))).scalar()
    keyed = files.select("name", F.explode(sizes).alias("n")).where(F.length("name") >= F.col("n")).select(F.expr("substring(name, 1, n)").alias("video_id"), "name")
    return ids.join(keyed, "video_id", "left").groupBy("video_id").agg(F.min("name").alias("name"))
