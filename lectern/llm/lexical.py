"""Ranked lexical search: document-at-a-time merging of compressed postings by shard.

1. ``build_index``: each task cuts its documents into shards of about ``SHARD_BYTES`` of text, sorted by doc_id. A shard gives,
   for each of its terms, the places of the documents that hold it (as gaps) and how often each does, as
   variable-length bytes, and a header of its ids and lengths under the empty term. Every row and every term is indexed.
2. ``search``: items are taken in blocks of ``ITEMS``; the postings of their terms and the headers meet by shard. Of an item, a heap of
   cursors keyed by their next document merges the postings in order of doc_id, a window of documents at a
   time: it ends where the first of the cursors in it has read a block of ``WINDOW`` postings. Scores are 64-bit integers.
3. Each item has a heap of its ``k`` best keyed by score, then doc_id, which is carried from shard to shard of a task. What
   the tasks' heaps hold, at most ``k`` rows an item and task, is merged by a window that keeps the ``k`` first.

Nothing but three numbers (documents, terms, bytes) comes to the driver. A common term has one row for each shard, and a shard is bounded by bytes, so
no term and no source makes a large group.

Edge cases: a null or wordless text, of a document or an item, is never found or finds nothing; rows that repeat a
doc_id are documents of their own, in any order among equals; a document without an id counts in all statistics but is not
returned; rows of one item_id are one item with the terms of all, and items without an id have no result; equal scores are
ordered by doc_id; a very long text is a shard of its own; empty tables give an empty result; other columns are ignored. Ids of
documents are whole numbers.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, materialise, tasks_for
from .textkit import ALNUM, bound_batches, find_words, map_batches, slabs, word_numbers

#: Bytes of text of a shard; postings that a window takes of one cursor; items searched together.
SHARD_BYTES, WINDOW, ITEMS = 16 << 20, 1024, 1024
BEST = 50


# --- compression


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 64 bits as bytes of seven bits each, the last below 128, and how many bytes each takes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[at[own] + k] = ((values[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[own] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw < 128) + 1
    begin = np.concatenate([[0], end[:-1]]).astype(np.int64)
    size, out = end - begin, np.zeros(len(end), np.uint64)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[own] |= (raw[begin[own] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def packed_rows(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A column of packed numbers; row k has those from ``first[k]`` to ``first[k + 1]``."""
    data, size = pack(values)
    bounds = np.concatenate([[0], np.cumsum(size)])[first].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])


# --- index

INDEX = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("total", T.LongType()),
])


def shard_rows(shard: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The header and the postings of a shard's documents."""
    order = pa.compute.sort_indices(ids, null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    parts: list[tuple] = []
    for slab in slabs(texts, 1 << 62):  # all at once
        words = find_words(slab, ALNUM)
        code, distinct = word_numbers(slab, words, ALNUM)
        parts.append((words.doc, code, distinct, np.diff(words.first)))
    doc, code, distinct, n = parts[0]
    filled = np.flatnonzero(n)
    place = np.cumsum(n > 0) - 1
    known = ids.take(pa.array(filled)).drop_null().to_numpy().astype(np.int64).view(np.uint64)
    pair, tf = np.unique(code * max(len(filled), 1) + place[doc], return_counts=True)
    term, place = np.divmod(pair, max(len(filled), 1))
    first = np.searchsorted(term, np.arange(len(distinct) + 1))
    gap = np.diff(place, prepend=0)
    gap[first[:-1]] = place[first[:-1]]  # each list begins anew
    head = lambda own: packed_rows(own, np.array([0, len(own)]))
    columns = [
        np.full(len(distinct) + 1, shard),
        pa.concat_arrays([pa.array([""], pa.string()), distinct.cast(pa.string())]),
        np.concatenate([[len(filled)], np.diff(first)]),
        pa.concat_arrays([head(np.diff(known, prepend=np.uint64(0))), packed_rows(gap, first)]),
        pa.concat_arrays([head(n[filled]), packed_rows(tf, first)]),
        np.concatenate([[n.sum()], np.add.reduceat(tf, first[:-1]) if len(tf) else []]).astype(np.int64),
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=INDEX.fieldNames())


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents, written: ``shard``, ``term``, ``df`` there, ``places``, ``counts`` and their ``total``; headers have the empty term."""
    bound_batches(docs.sparkSession)

    def run(batches):
        shard, held, size = (TaskContext.get().partitionId() << 32), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= shard_bytes:
                yield from shard_of(shard, held)
                shard, held, size = shard + 1, [], 0
        if held:
            yield from shard_of(shard, held)

    def shard_of(shard: int, held: list):
        table = pa.Table.from_batches(held)
        rows = shard_rows(shard, table.column(0).combine_chunks(), table.column(1).cast(pa.large_string()).combine_chunks())
        for k in range(0, rows.num_rows, 50_000):
            yield rows.slice(k, 50_000)

    return materialise(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, INDEX), "index")


# --- search


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (``item_id``, ``term``)."""

    def run(batch: pa.RecordBatch) -> dict:
        owner, terms = [], []
        for slab in slabs(batch.column(1)):
            words = find_words(slab, ALNUM)
            code, distinct = word_numbers(slab, words, ALNUM)
            owner.append(slab.lo + words.doc)
            terms.append(distinct.cast(pa.string()).take(pa.array(code)))
        return {"item_id": batch.column(0).take(pa.array(np.concatenate(owner))), "term": pa.concat_arrays(terms)}

    schema = T.StructType([items.schema["item_id"], T.StructField("term", T.StringType())])
    return map_batches(items.select("item_id", "text"), run, schema).where("item_id is not null").distinct()


class Best:
    """The ``k`` best (score, doc_id): a heap whose first is the least score and, among equals, the greatest doc_id."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        least = self.heap[0][0] if len(self.heap) == self.k else 1
        if len(scores) > self.k:
            least = max(least, int(np.partition(scores, len(scores) - self.k)[len(scores) - self.k]))
        own = np.flatnonzero(scores >= least)
        for entry in zip(scores[own].tolist(), (-ids[own]).tolist()):
            if len(self.heap) < self.k:
                heappush(self.heap, entry)
            else:
                heappushpop(self.heap, entry)


def merge(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, best: Best, window: int = WINDOW) -> None:
    """Score the documents of an item's lists (places, ascending, and parts of the score) in order and offer them to ``best``."""
    read = [0] * len(lists)
    heap = [(int(places[0]), t) for t, (places, _) in enumerate(lists)]
    heapify(heap)
    while heap:
        # cursors by their next document, as long as that is no later than the first end of a block
        taken, end = [], None
        while heap and (end is None or heap[0][0] <= end):
            t = heappop(heap)[1]
            places = lists[t][0]
            stop = int(places[min(read[t] + window, len(places)) - 1])
            end = stop if end is None else min(end, stop)
            taken.append(t)
        cut = []
        for t in taken:
            places, parts = lists[t]
            a, b = read[t], int(np.searchsorted(places, end, "right"))
            cut.append((places[a:b], parts[a:b]))
            read[t] = b
            if b < len(places):
                heappush(heap, (int(places[b]), t))
        places, scores = cut[0]
        if len(cut) > 1:
            places, scores = (np.concatenate(x) for x in zip(*cut))
            order = np.argsort(places, kind="stable")
            places, scores = places[order], scores[order]
            first = np.flatnonzero(np.diff(places, prepend=-1))
            places, scores = places[first], np.add.reduceat(scores, first)
        named = int(np.searchsorted(places, len(ids)))  # those behind have no id
        if named:
            best.offer(ids[places[:named]], scores[:named])


def search(index: DataFrame, items: DataFrame, *, item_id: str = "item_id", text: str = "text", k: int = BEST, block: int = ITEMS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents of each item."""
    spark = index.sparkSession
    bound_batches(spark)
    header = F.col("term") == ""
    size = F.sum(F.octet_length("places") + F.octet_length("counts") + 64)
    n_docs, n_terms, n_bytes = (x or 0 for x in index.agg(F.sum(F.when(header, F.col("df"))), F.sum(F.when(header, F.col("total"))), size).first())
    asked = materialise(item_terms(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))), "asked")
    blocks = max(1, -(-asked.select("item_id").distinct().count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    # items of each term; the empty term brings the headers to every block
    wanted = asked.groupBy("block", "term").agg(F.collect_list("item_id").alias("items")).unionByName(spark.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit("").alias("term"), F.array().cast(T.ArrayType(items.schema[item_id].dataType)).alias("items")))
    df = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("all_df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("all_df") + 1))).cast("long").alias("weight")
    wanted = materialise(wanted.join(df, "term", "left").select("block", "term", "items", weight), "wanted")
    found = index.select("shard", "term", "places", "counts").join(wanted, "term")
    placed = found.repartition(tasks_for(n_bytes * blocks), "shard").sortWithinPartitions("block", "shard", "term")
    schema = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    best = placed.select("block", "shard", "term", "weight", "items", "places", "counts").mapInArrow(lambda batches: ranked(batches, n_docs, n_terms, k, schema), schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def shards(batches):
    """(block, [(term, weight, items, places, counts)]) of each shard, header first."""
    at, rows = None, []
    for batch in batches:
        for block, shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (block, shard) != at:
                if rows:
                    yield at[0], rows
                at, rows = (block, shard), []
            rows.append(row)
    if rows:
        yield at[0], rows


def ranked(batches, n_docs: int, n_terms: int, k: int, schema: T.StructType):
    """The best documents of each item in the shards of a task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def flush(found: dict):
        out = [(item, -doc, score) for item, best in found.items() for score, doc in best.heap]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[], [], []], arrow)], schema=arrow)

    now, found = None, {}
    for block, rows in shards(batches):
        if block != now:
            yield flush(found)
            now, found = block, {}
        ids = np.cumsum(unpack(rows[0][3]), dtype=np.uint64).view(np.int64)
        m = 50 + 50 * unpack(rows[0][4]).astype(np.int64) * n_docs // max(n_terms, 1)
        by_item: dict = {}
        for _, weight, items, places, counts in rows[1:]:
            at, tf = np.cumsum(unpack(places).astype(np.int64)), unpack(counts).astype(np.int64)
            part = weight * (1_000_000_000 * tf // (1000 * tf + 20 * m[at]))
            for item in items:
                by_item.setdefault(item, []).append((at, part))
        for item, lists in by_item.items():
            merge(lists, ids, found.setdefault(item, Best(k)))
    yield flush(found)


def rank_documents(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = BEST) -> DataFrame:
    """Index ``docs`` and search ``items`` (``item_id``, ``text``) in it."""
    out = materialise(search(index := build_index(docs, doc_id=doc_id, text=text), items, k=k), "ranked")
    discard(index)
    return out
