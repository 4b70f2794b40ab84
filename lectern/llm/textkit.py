"""Vectorised text primitives shared by the operators.

Texts arrive as Arrow string arrays. They are handled as UTF-8 bytes in *slabs*: runs of whole
texts of about ``SLAB_BYTES`` (a longer text is a slab of its own, so memory follows the longest
text, never the batch). A null text counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SLAB_BYTES = 1 << 18
#: Bytes and rows of one Arrow batch handed to Python.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def arrow_type(dt: T.DataType) -> pa.DataType:
    """The Arrow type Spark uses for ``dt``."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(dt)


def map_batches(df: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` by a function from a record batch to a dict of columns or None."""
    names = schema.fieldNames()
    kinds = [arrow_type(f.dataType) for f in schema.fields]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out = fn(batch)
            if out is None:
                continue
            cols = [out[n] if isinstance(out[n], (pa.Array, pa.ChunkedArray)) else pa.array(out[n], k) for n, k in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([c.cast(k) if c.type != k else c for c, k in zip(cols, kinds)], names=names)

    return df.mapInArrow(run, schema)


class Slab(NamedTuple):
    """Rows ``lo`` to ``hi`` of an array; ``offs`` are the bounds of their bytes in ``buf``."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray

    def text(self, k: int) -> bytes:
        return self.buf[self.offs[k] : self.offs[k + 1]].tobytes()


def slabs(col: pa.Array, limit: int = SLAB_BYTES) -> Iterator[Slab]:
    """Cut a string or binary array into slabs of whole texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_large_binary(col.type) else "")
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Slab(lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for the bytes in the ranges (ends included)."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower-cased: digits, letters, all beyond ASCII.
ALNUM = byte_class((48, 57), (65, 90), (97, 122), (128, 255))
#: Bytes of ``[^\x20\x09-\x0D]``.
NONSPACE = ~byte_class((32, 32), (9, 13))
CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CODE_LOWER = CODE[LOWER]
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, BASE_INV, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of them."""
    return _powers(1 << max(16, (n - 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def prefix_hash(buf: np.ndarray, code: np.ndarray = CODE) -> np.ndarray:
    """Prefix sums of the polynomial hash; ``range_hash`` takes any range from them."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(code[buf] * powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges, equal for equal bytes wherever they lie."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


class Words(NamedTuple):
    """Words of a slab: bounds of their bytes, and the first word of each text (one entry more than texts)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(slab: Slab, table: np.ndarray) -> Words:
    """Maximal runs of the bytes of ``table``; none crosses a text's bounds."""
    inside = table[slab.buf]
    n = len(inside)
    begins, ends = inside.copy(), inside.copy()
    if n:
        filled = slab.offs[:-1] < slab.offs[1:]
        np.logical_and(inside[1:], ~inside[:-1], out=begins[1:])
        np.logical_and(inside[:-1], ~inside[1:], out=ends[:-1])
        heads, tails = slab.offs[:-1][filled], slab.offs[1:][filled] - 1
        begins[heads], ends[tails] = inside[heads], inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, slab.offs))


def word_numbers(slab: Slab, words: Words, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Each word's place among the slab's distinct words, and those words: told apart byte by byte, not by hashes."""
    data = slab.buf[table[slab.buf]]
    size = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(size), pa.py_buffer(LOWER[data] if lower else data)])
    coded = found.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def strong(rows: np.ndarray, extra: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row of a matrix of bytes, and of a number to each: weighted sums that doubles hold exactly."""
    weights = np.random.default_rng(20240229).integers(1, 1 << 36, (rows.shape[1], 4)).astype(np.float64)
    if rows.shape[1] > 512:
        raise ValueError("sums would not be exact")
    sums = np.empty((len(rows), 4), np.float64)
    for k in range(0, len(rows), 4096):
        np.matmul(rows[k : k + 4096].astype(np.float64), weights, out=sums[k : k + 4096])
    a, b, c, d = sums.astype(np.uint64).T
    extra = np.asarray(extra).astype(np.uint64)
    return mix(a + mix(b + mix(extra))), mix(c + mix(d + mix(extra)))


#: Words of at most so many bytes are hashed together, longer ones one by one.
SHORT_WORD = 32


def word_digests(distinct: pa.Array) -> np.ndarray:
    """Two 64-bit hashes of each word, as two columns; none depends on the form of the word (see ``strong``)."""
    n = len(distinct)
    _, offsets, data = distinct.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, distinct.offset * 8)
    size = np.diff(offs)
    out = np.zeros((n, 2), np.uint64)
    if not n or data is None or not data.size:
        return out
    buf = np.concatenate([np.frombuffer(data, np.uint8)[: offs[-1]], np.zeros(SHORT_WORD, np.uint8)])
    column = np.arange(SHORT_WORD)
    short = np.flatnonzero(size <= SHORT_WORD)
    for k in range(0, len(short), 8192):
        rows = short[k : k + 8192]
        cells = buf[offs[rows][:, None] + column] * (column < size[rows][:, None])
        out[rows, 0], out[rows, 1] = strong(cells, size[rows])
    for k in np.flatnonzero(size > SHORT_WORD).tolist():
        out[k] = np.frombuffer(hashlib.blake2b(buf[offs[k] : offs[k + 1]].tobytes(), digest_size=16).digest(), np.uint64)
    return out


def shingle_hashes(digests: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of each text's windows of ``n`` words, and the first window of each text.

    A text of fewer words, but not none, has one window of them all.
    """
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(first[:-1] - begin[:-1], made) + np.arange(begin[-1])
    size = np.repeat(np.minimum(count, n), made)
    weights = np.random.default_rng(20240301).integers(0, 2**63, (2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for lane in range(2):
        own = np.ascontiguousarray(digests[:, lane])
        total = size.astype(np.uint64) * MIX2
        for k in range(n):
            part = own[np.minimum(at + k, max(len(own) - 1, 0))] * weights[lane, k] if len(own) else total
            total = total + (part if (size > k).all() else np.where(size > k, part, np.uint64(0)))
        out.append(mix(total))
    return out[0], out[1], begin


def codepoints(buf: np.ndarray) -> int:
    """Code points in UTF-8 bytes: those that don't continue another."""
    return int(np.count_nonzero((buf & 0xC0) != 0x80))


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the first index of each row."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))
