"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts and benchmark items are cut into words, ASCII letters lower-cased. Patterns are the windows of
``window`` consecutive words of every item; a shorter item that has words is one pattern. For patterns
of m words, the *shift table* tells for each hashed block of ``BLOCK`` words how far the search may
move: a block that ends no pattern prefix lets it skip up to m - BLOCK + 1 words. Where the shift is 0,
the hash of the last m words picks a bucket of test strings, and comparison of the words confirms.

Words are numbers in the items' vocabulary (a word of no item is number -1, which no pattern holds), so
comparing numbers is comparing words. All tables are flat arrays: for a block of items of ``ITEM_BYTES``
bytes of text they take some ten bytes for each byte of text, on the executors only. The driver holds
one block of texts at a time. Each block is broadcast by itself and searched in a pass of its own, between
which the table is written, so what one task holds does not grow with the benchmark.

Edge cases: a null or empty text has no words and hits nothing; a null or wordless item has no pattern;
an item without an id is searched too and is a null, the last, of ``hit_items``; repeated items and equal
windows all count; repeated documents each get their row; a very long text is a slab by itself, so memory
follows the longest text; an empty table gives an empty result. Other columns of the documents pass
through; the operator's columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, materialise
from .textkit import ALNUM, MIX1, Slab, bound_batches, find_words, map_batches, mix, powers, slabs, word_numbers

ITEM_BYTES = 8 << 20
BLOCK = 2
SLAB = 1 << 20


def window_sums(numbers: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words; each depends on those words alone."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    hashes = mix((numbers + 2).astype(np.uint64) * MIX1)
    total = np.zeros(n, np.uint64)
    weights = powers(size)[0]
    for k in range(size):
        total += hashes[k : k + n] * weights[k]
    return mix(total)


class WuManber:
    """Patterns of ``m`` words: shift table, buckets by suffix hash (sorted), and test strings (places in ``flat``)."""

    def __init__(self, m: int, flat: np.ndarray, start: np.ndarray, item: np.ndarray):
        self.m, self.block, self.flat = m, min(BLOCK, m), flat
        bits = min(max(len(start) * 8, 1 << 16).bit_length(), 24)
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.block + 1, np.uint8 if m < 256 else np.uint32)
        blocks = (window_sums(flat, self.block) & self.mask).astype(np.int32 if bits < 31 else np.int64)
        for k in range(m - self.block + 1):  # later places of a block allow shorter shifts, and stay
            self.shift[blocks[start + k]] = m - self.block - k
        suffix = window_sums(flat, m)[start]
        order = np.argsort(suffix, kind="stable")
        suffix, start, item = suffix[order], start[order], item[order]
        # equal test strings are one, with the items that hold it
        new = np.ones(len(start), bool)
        tied = np.flatnonzero(suffix[1:] == suffix[:-1]) + 1
        for k in range(0, len(tied), 1 << 16):
            rows = tied[k : k + (1 << 16)]
            new[rows] = (flat[start[rows][:, None] + np.arange(m)] != flat[start[rows - 1][:, None] + np.arange(m)]).any(1)
        own = new.copy()
        own[1:] |= item[1:] != item[:-1]
        self.suffix, self.start, self.items = suffix[new], start[new], item[own]
        self.first = np.append(np.flatnonzero(new[own]), len(self.items))

    def search(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``numbers`` (texts begin at ``first``) where a pattern starts, and the pattern."""
        m, seen = self.m, []
        if len(numbers) < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        moves = self.shift[window_sums(numbers, self.block) & self.mask]
        moves = moves.tobytes() if moves.dtype == np.uint8 else moves.tolist()
        bounds, last = first.tolist(), m - self.block
        for k in range(len(bounds) - 1):
            at, stop = bounds[k], bounds[k + 1] - m
            while at <= stop:
                move = moves[at + last]
                if move:
                    at += move
                else:
                    seen.append(at)
                    at += 1
        place = np.array(seen, np.int64)
        suffix = window_sums(numbers, m)[place]
        low, high = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
        found = [(np.zeros(0, np.int64),) * 2]
        step = 0
        while len(place := place[low + step < high]):  # test strings of a bucket, one after the other
            low, high = low[low + step < high], high[low + step < high]
            pattern = low + step
            for k in range(0, len(place), 1 << 16):
                p, q = place[k : k + (1 << 16)], pattern[k : k + (1 << 16)]
                same = (numbers[p[:, None] + np.arange(m)] == self.flat[self.start[q][:, None] + np.arange(m)]).all(1)
                found.append((p[same], q[same]))
            step += 1
        return tuple(np.concatenate(x) for x in zip(*found))


class Items:
    """The searchers of a block of items, one for each pattern length, and their vocabulary."""

    def __init__(self, texts: list[str], window: int):
        parts, first, words_of = [], [np.zeros(1, np.int64)], []
        for slab in slabs(pa.array(texts, pa.large_string())):
            words = find_words(slab, ALNUM)
            numbers, distinct = word_numbers(slab, words, ALNUM)
            parts.append(numbers)
            words_of.append(distinct)
            first.append(first[-1][-1] + words.first[1:])
        first = np.concatenate(first)
        self.words = pa.concat_arrays(words_of).unique() if words_of else pa.array([], pa.large_binary())
        flat = np.concatenate([pc.index_in(d, self.words).to_numpy()[p] for d, p in zip(words_of, parts)]).astype(np.int32) if parts else np.zeros(0, np.int32)
        size = np.diff(first)
        self.searchers = []
        for m in sorted({*np.minimum(size, window).tolist()} - {0}):
            own = np.flatnonzero(np.minimum(size, window) == m)
            made = size[own] - m + 1
            begin = np.concatenate([[0], np.cumsum(made)])
            start = np.repeat(first[own] - begin[:-1], made) + np.arange(begin[-1])
            self.searchers.append(WuManber(m, flat, start.astype(np.int32), np.repeat(own, made).astype(np.int32)))

    def scan(self, slab: Slab) -> tuple[np.ndarray, list[list[list[int]]], list[list[int]]]:
        """Words of each text, the unions of the word spans that are hit, and the places of the items that occur."""
        words = find_words(slab, ALNUM)
        numbers, distinct = word_numbers(slab, words, ALNUM)
        known = pc.fill_null(pc.index_in(distinct, self.words), -1).to_numpy()
        numbers = known[numbers].astype(np.int32)
        n, first = slab.hi - slab.lo, words.first
        delta = np.zeros(len(numbers) + 1, np.int64)
        items: list[set[int]] = [set() for _ in range(n)]
        for s in self.searchers:
            place, pattern = s.search(numbers, first)
            np.add.at(delta, place, 1)
            np.add.at(delta, place + s.m, -1)
            text = np.searchsorted(first, place, "right") - 1
            for k, p in {*zip(text.tolist(), pattern.tolist())}:
                items[k].update(s.items[s.first[p] : s.first[p + 1]].tolist())
        spans: list[list[list[int]]] = [[] for _ in range(n)]
        if any(items):
            hit = np.cumsum(delta[:-1]) > 0
            begin, end = hit.copy(), hit.copy()
            begin[1:] &= ~hit[:-1]
            end[:-1] &= ~hit[1:]
            heads = first[:-1][first[:-1] < first[1:]]  # no span runs over a text's bounds
            begin[heads] = hit[heads]
            end[heads[1:] - 1] = hit[heads[1:] - 1]
            a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
            text = np.searchsorted(first, a, "right") - 1
            for k, x, y in zip(text.tolist(), (a - first[text]).tolist(), (b - first[text]).tolist()):
                spans[k].append([x, y])
        return np.diff(first), spans, [sorted(x) for x in items]


def union(spans: list[list[int]]) -> list[list[int]]:
    """Merge overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items in blocks of at most ``limit`` bytes of text (a longer item is a block); one block at a time is on the driver."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.octet_length(text_col).alias("n")).where(F.col(text_col).isNotNull())
    for i, t, n in rows.toLocalIterator():
        if texts and size + n > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += n
    yield ids, texts


#: Tables that this worker made, by the number of the broadcast; the last two are kept.
_MADE: dict[int, Items] = {}


def compiled(block, number: int, window: int) -> Items:
    if number not in _MADE:
        while len(_MADE) > 1:
            del _MADE[next(iter(_MADE))]
        _MADE[number] = Items(block.value[1], window)
    return _MADE[number]


OWN = ["n_words", "hit_spans", "hit_items"]


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Add ``n_words``, ``hit_spans`` (unions of word ranges, end exclusive) and ``hit_items`` (ids, of the items' type) to ``docs``."""
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.drop(*OWN)
    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("hit_items", T.ArrayType(items.schema[item_id].dataType))])
    out, before = base, None
    for n, block in enumerate(item_blocks(items, item_id, item_text, item_bytes)):
        if n:
            out, done = materialise(out, "searched"), before
            before = out
            if done is not None:
                discard(done)
        shared = spark.sparkContext.broadcast(block)
        number = shared._jbroadcast.id()

        def scan(batch: pa.RecordBatch, shared=shared, number=number, more=n > 0) -> dict:
            own, ids = compiled(shared, number, window), shared.value[0]
            counts, spans, found = [], [], []
            for slab in slabs(batch.column(text), SLAB):
                c, s, i = own.scan(slab)
                counts.append(c)
                spans += s
                found += [{ids[k] for k in x} for x in i]
            if more:
                spans = [union(a + b) for a, b in zip(spans, batch.column("hit_spans").to_pylist())]
                found = [a | {*b} for a, b in zip(found, batch.column("hit_items").to_pylist())]
            return {name: batch.column(name) for name in batch.schema.names} | {"n_words": np.concatenate(counts), "hit_spans": spans, "hit_items": [sorted(x - {None}) + [None] * (None in x) for x in found]}

        out = map_batches(out, scan, schema)
    return out
