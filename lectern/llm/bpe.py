"""Byte-level BPE by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised by itself; at its start the cut may
fall inside a pre-token, so its first boundaries can be wrong, and at its end the last ones can, since
what follows is not seen. The pattern never looks back, so once two chunks share a boundary all later
ones agree: the *stitch* follows the left chunk up to the first boundary that both have, then the right
one. Where an overlap holds no common boundary (one pre-token longer than the overlap), the left chunk
is read on past its end until it resynchronises. The pieces are then merged by rank, each by itself
(the merging of one piece is ``tiktoken``'s), and decoding concatenates the raw bytes of the ids.

All chunks of a slab of texts are pre-tokenised at once, as lanes of one array pass; ``CHUNK`` is small
enough that ordinary texts are cut and stitched too. A text beyond ``SECTION`` bytes is encoded section by
section, each up to a boundary that is sure, so memory follows the text and its ids, not the arrays.

Edge cases: a null or empty text has no tokens; lone bytes cannot occur in a string column; repeated
rows are encoded alike and each kept; pairs of equal rank cannot occur, and of equal pairs the leftmost is
joined first; an empty table gives an empty result. Other columns pass through; the operator's columns
replace columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import Slab, arrow_type, bound_batches, lists, map_batches, slabs

CHUNK, OVERLAP = 4096, 256
SLAB, SECTION = 1 << 20, 4 << 20
#: Bytes that the pieces a worker remembers, and their ids, may take; longer pieces than ``LONG`` bytes are not remembered.
REMEMBERED, LONG = 64 << 20, 1024
#: Bytes that a remembered piece takes besides its letters and ids.
ENTRY = 150


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


#: The pattern whose boundaries ``Scan`` finds for whole arrays at once. Other patterns go through ``regex``.
SCANNED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def letter_classes() -> bytes:
    """The class of every code point (packed), as ``tiktoken``'s own Unicode tables have it.

    Those of ``regex`` are taken as a guess, and each code point is put behind a letter, a digit or a mark, as
    guessed: it is of that class if both are one pre-token, which shows as one token of the two bytes that meet.
    What is not as guessed is tried behind all three.
    """
    guess = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for k, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(p, every):
            guess[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = k
    guess[0xD800:0xE000] = OTHER
    ranks = {bytes([x]): x for x in range(256)} | {bytes([a, x]): 256 + 256 * k + x for k, a in enumerate(b"a1!") for x in range(256)}
    prober = tiktoken.Encoding("probe", pat_str=SCANNED, mergeable_ranks=ranks, special_tokens={})
    before = {LETTER: "a", NUMBER: "1", OTHER: "!"}

    def joins(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
        parts = [before[k] + chr(p) + "\n" for p, k in zip(points.tolist(), kind.tolist())]
        ids = np.array(prober.encode_ordinary("".join(parts)), np.int64)
        size = np.where(ids < 256, 1, 2)
        at = np.cumsum(size) - size
        start = np.cumsum([0, *[len(x.encode()) for x in parts]])[:-1]
        return size[np.searchsorted(at, start)] == 2

    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    sure = points[guess[points] != BLANK]
    wrong = sure[~joins(sure, guess[sure])]
    rest = np.concatenate([wrong, points[guess[points] == BLANK]])
    guess[rest] = BLANK
    for k in before:
        guess[rest[joins(rest, np.full(len(rest), k))]] = k
    return zlib.compress(guess.tobytes())


class Scan:
    """Ends of the matches of ``SCANNED`` in arrays of code points.

    Each code point is a letter, a number, a blank or another; a match is a run of one class, with these
    exceptions: of a run of blanks before something else the last is left for itself, and joins what
    follows if it is a space; an apostrophe alone takes one of seven endings from the letters behind it.
    """

    def __init__(self, classes: bytes | None = None):
        self.classes = np.frombuffer(zlib.decompress(classes or letter_classes()), np.uint8)

    def ends(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Ends of all matches; each stretch between ``bounds`` (from 0 on) is a text of its own."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes[points]
        first = np.zeros(n + 1, bool)  # where a text starts
        first[bounds] = True
        start = first.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        blank = kind == BLANK
        # the last blank before something else of its text
        last = np.zeros(n, bool)
        last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
        at = np.flatnonzero(last)
        start[at] = True
        joins = at[points[at] == 32]
        start[joins + 1] = False
        # an apostrophe that starts a match and is followed by letters
        q = np.flatnonzero((points == 39) & start[:n])
        q = q[q + 1 < n]
        q = q[(kind[q + 1] == LETTER) & ~first[q + 1]]
        if len(q):
            one = points[q + 1]
            two = points[np.minimum(q + 2, n - 1)]
            # the second letter must be of the same text
            same = (q + 2 < n) & ~first[np.minimum(q + 2, n)]
            size = np.zeros(len(q), np.int64)
            size[np.isin(one, [ord(c) for c in "stmd"])] = 1
            for x, y in ("re", "ve", "ll"):
                size[same & (one == ord(x)) & (two == ord(y))] = 2
            own = q[size > 0]
            start[own + 1] = False
            start[own + 1 + size[size > 0]] = True
        start[n] = True
        return np.flatnonzero(start)[1:]


class Bpe:
    """Merges by rank; one per worker, so that remembered pieces are shared by all batches."""

    _made: dict[tuple[str, str], Bpe] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str, classes: bytes | None = None):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.scan = Scan(classes) if pattern == SCANNED else None
        self.merger = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.tokens[i] = b
        self.digits = [b"%d" % i for i in range(len(self.tokens))]
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.first, self.held = array("i"), array("q", [0]), 0

    @classmethod
    def of(cls, path: str, pattern: str, classes: bytes | None = None) -> Bpe:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(load_ranks(path), pattern, classes)
        return cls._made[path, pattern]

    def boundaries(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Ends of the pre-tokens of texts that lie one behind the other."""
        if self.scan:
            return self.scan.ends(points, bounds)
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        cut = [*bounds.tolist(), len(text)]
        return np.array([m.end() for a, b in pairwise(cut) for m in self.pattern.finditer(text, a, b)], np.int64)

    def pretokenise(self, points: np.ndarray, bounds: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """Ends of the pre-tokens of some texts; those longer than ``chunk`` are cut, scanned by chunk and stitched."""
        cut = np.append(bounds, len(points))
        if (np.diff(cut) <= chunk).all():
            return self.boundaries(points, bounds)
        spans, owner = [], []
        for k, (a, b) in enumerate(pairwise(cut.tolist())):
            for x in range(a, max(a + 1, b - overlap), chunk - overlap):
                spans.append((x, min(b, x + chunk)))
                owner.append(k)
        sizes = np.array([b - a for a, b in spans])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        found = self.boundaries(np.concatenate([points[a:b] for a, b in spans]), begin[:-1])
        parts = [found[x:y] - o + a for (a, _), o, x, y in zip(spans, begin[:-1], np.searchsorted(found, begin[:-1], "right"), np.searchsorted(found, begin[1:], "right"))]
        out, k = [], 0
        while k < len(spans):
            e = k + 1
            while e < len(spans) and owner[e] == owner[k]:
                e += 1
            a, b = cut[owner[k]], cut[owner[k] + 1]
            out.append(parts[k] if e == k + 1 else a + self.stitch(points[a:b], [(x - a, y - a) for x, y in spans[k:e]], [p - a for p in parts[k:e]]))
            k = e
        return np.concatenate(out)

    def stitch(self, points: np.ndarray, spans: list[tuple[int, int]], pieces: list[np.ndarray]) -> np.ndarray:
        """Join the boundaries of a text's chunks into those of the whole text."""
        out, left = [], pieces[0]
        for (a, _), right, (_, stop) in zip(spans[1:], pieces[1:], spans):
            # the last two pre-tokens of the left chunk can depend on what follows it
            sure = left[:-2] if stop < len(points) else left
            both = np.intersect1d(sure[np.searchsorted(sure, a, "right") :], right, assume_unique=True)
            if len(both):
                join = both[0]
                out.append(sure[: np.searchsorted(sure, join, "right")])
            else:
                # read on from the last sure boundary until a boundary of the right chunk comes
                out.append(sure)
                known = [int(p[-1]) for p in out if len(p)]
                join, own = (known[-1] if known else 0), set(right.tolist())
                more, size = [], 2 * OVERLAP
                while True:
                    # what is read must not end before the last of its pre-tokens is sure
                    rest = self.boundaries(points[join : join + size], np.zeros(1, np.int64)) + join
                    rest = rest if join + size >= len(points) else rest[:-2]
                    met = [k for k, x in enumerate(rest.tolist()) if x in own]
                    if met or join + size >= len(points):
                        more = rest[: met[0] + 1] if met else rest
                        join = int(more[-1]) if len(more) else join
                        break
                    size *= 2
                out.append(np.array(more, np.int64))
            left = right[np.searchsorted(right, join, "right") :]
        return np.concatenate([*out, left]).astype(np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of least rank, leftmost first, is joined until none is left."""
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else self.merger._encode_single_piece(piece)

    def encode_slab(self, slab: Slab, chunk: int = CHUNK, overlap: int = OVERLAP, section: int = SECTION) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slab, and the first of each text."""
        if slab.hi - slab.lo == 1 and len(slab.buf) > section:
            ids = self.encode_sections(slab.buf, chunk, overlap, section)
            return ids, np.array([0, len(ids)])
        end = self.byte_ends(slab.buf, slab.offs, chunk, overlap)
        ids, count = self.encode_bounds(slab.buf, end)
        return ids, np.concatenate([[0], np.cumsum(count)])[np.searchsorted(end, slab.offs, "right")]

    def byte_ends(self, buf: np.ndarray, offs: np.ndarray, chunk: int, overlap: int) -> np.ndarray:
        """Ends, in bytes, of the pre-tokens of the texts between ``offs``."""
        at = np.flatnonzero((buf & 0xC0) != 0x80)  # byte offsets of the code points
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        filled = offs[:-1][offs[:-1] < offs[1:]]
        return np.append(at, len(buf))[self.pretokenise(points, np.searchsorted(at, filled), chunk, overlap)]

    def encode_sections(self, buf: np.ndarray, chunk: int, overlap: int, section: int) -> np.ndarray:
        """Ids of one long text. As the pattern never looks back, each section starts at a sure end of the one before."""
        out, begin, size = [], 0, section
        while begin < len(buf):
            stop = min(len(buf), begin + size)
            while stop < len(buf) and buf[stop] & 0xC0 == 0x80:
                stop += 1
            part = buf[begin:stop]
            end = self.byte_ends(part, np.array([0, len(part)]), chunk, overlap)
            if stop < len(buf):
                end = end[:-2]  # these can depend on what follows
                if not len(end):
                    size *= 2
                    continue
            out.append(self.encode_bounds(part[: end[-1]], end)[0])
            begin, size = begin + int(end[-1]), section
        return np.concatenate(out)

    def encode_bounds(self, buf: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of bytes whose pre-tokens end at the given places, and how many each has; equal pieces are encoded once."""
        bounds = np.concatenate([[0], end]).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(end), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        if self.held > REMEMBERED:
            self._forget()
        slot, slots, long = self.slot, [], []
        for k, piece in enumerate(pieces.dictionary.to_pylist()):
            s = slot.get(piece)
            if s is None:
                if len(piece) > LONG:
                    long.append((k, piece))
                    s = -1
                else:
                    s = slot[piece] = self._add(piece)
                    self.held += len(piece) + 4 * (self.first[-1] - self.first[-2]) + ENTRY
            slots.append(s)
        kept = len(self.first)
        for k, piece in long:
            slots[k] = self._add(piece)
        out = self._expand(np.array(slots, np.int64)[pieces.indices.to_numpy()])
        del self.first[kept:], self.flat[self.first[-1] :]
        return out

    def _add(self, piece: bytes) -> int:
        self.flat.extend(self.merge(piece))
        self.first.append(len(self.flat))
        return len(self.first) - 2

    def _expand(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, first = np.frombuffer(self.flat, np.int32), np.frombuffer(self.first, np.int64)
        count = first[slots + 1] - first[slots]
        total = np.cumsum(count)
        at = np.repeat(first[slots] - (total - count), count) + np.arange(total[-1] if len(total) else 0)
        return (flat[at] if len(at) else np.zeros(0, np.int32)), count

    def encode(self, text: str) -> list[int]:
        slab = next(slabs(pa.array([text], pa.large_string())))
        return self.encode_slab(slab)[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, reduce=None, fields: list[T.StructField] | None = None) -> DataFrame:
    """Add ``tokens`` (ids) to ``docs``, in one pass over them.

    With ``reduce`` and ``fields`` those columns are added instead, made from the ids where they arise:
    ``reduce(bpe, ids, first)`` gets the flat ids of some texts and the first id of each.
    """
    bound_batches(docs.sparkSession)
    fields = fields or [T.StructField("tokens", T.ArrayType(T.IntegerType()))]
    reduce = reduce or (lambda bpe, ids, first: {"tokens": lists(ids, first, pa.int32())})
    base = docs.drop(*[f.name for f in fields])
    schema = T.StructType([*base.schema.fields, *fields])
    classes = letter_classes() if pattern == SCANNED else None

    def run(batch: pa.RecordBatch) -> dict:
        bpe = Bpe.of(ranks_path, pattern, classes)
        parts = [reduce(bpe, *bpe.encode_slab(s, chunk, overlap)) for s in slabs(batch.column(text), SLAB)]
        return {n: batch.column(n) for n in batch.schema.names} | {f.name: gather([p[f.name] for p in parts], arrow_type(f.dataType)) for f in fields}

    return map_batches(base, run, schema)


def gather(parts: list, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([p.cast(kind) if isinstance(p, pa.Array) else pa.array(p, kind) for p in parts])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def decode(rows: DataFrame, ranks_path: str, pattern: str, *, tokens: str = "tokens", out: str = "decoded") -> DataFrame:
    """Add the bytes of the ids in ``tokens``: their tokens' raw bytes, concatenated."""
    bound_batches(rows.sparkSession)
    base = rows.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.BinaryType())])
    classes = letter_classes() if pattern == SCANNED else None

    def run(batch: pa.RecordBatch) -> dict:
        bpe = Bpe.of(ranks_path, pattern, classes)
        return {n: batch.column(n) for n in batch.schema.names} | {out: pa.array([bpe.decode(x or []) for x in batch.column(tokens).to_pylist()], pa.binary())}

    return map_batches(base, run, schema)


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def digests(bpe: Bpe, ids: np.ndarray, first: np.ndarray) -> dict:
    """For ``encode``: number of ids, SHA-256 of the ids in decimal joined by spaces, and of the decoded bytes."""
    digits = bpe.digits
    flat, out = ids.tolist(), {f.name: [] for f in DIGESTS}
    for a, b in pairwise(first.tolist()):
        own = flat[a:b]
        out["n_tokens"].append(b - a)
        out["ids_sha256"].append(hashlib.sha256(b" ".join([digits[i] for i in own])).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(bpe.decode(own)).hexdigest())
    return out


IDS_AND_DIGEST = [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]


def ids_and_digest(bpe: Bpe, ids: np.ndarray, first: np.ndarray) -> dict:
    """For ``encode``: the ids, and the SHA-256 of the bytes that they decode to."""
    flat = ids.tolist()
    decoded = [hashlib.sha256(bpe.decode(flat[a:b])).hexdigest() for a, b in pairwise(first.tolist())]
    return {"tokens": lists(ids, first, pa.int32()), "decoded_sha256": decoded}
