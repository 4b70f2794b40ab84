"""Exact removal of repeated strings by a common-prefix-aware distributed merge sort of suffixes.

Every byte covered by a string of ``least`` bytes that also starts elsewhere is removed. Sorting the
suffixes at all bytes would move many times the input, so only those at *anchors* are sorted: positions
whose hash of ``GRAM`` bytes is least in some window of ``WINDOW`` positions. Windows with equal bytes
have equal anchors, so two equal strings of ``least`` bytes share an anchor within their first
``WINDOW`` positions, and the ``KEY`` bytes from there on agree.

1. *Runs.* A task sorts the suffixes (their first KEY bytes) of about ``RUN_BYTES`` of text, front-codes
   them (length of the prefix shared with the one before, then the rest), and exchanges the run's parts
   by a hash of the KEY bytes, so a common beginning with many continuations is no hot key.
2. *Merge.* A loser tree merges the runs of a bucket. Each run's head knows its common prefix with the
   last output; the longer one wins without a comparison, and on equal lengths comparing starts behind
   the known prefix. What comes out next to each other with KEY common bytes is a *class*.
3. Within a class, anchors whose whole neighbourhoods (all bytes that a string over the anchor can hold)
   agree by a 128-bit hash are covered at once; of each other neighbourhood, one is looked at exactly: its bytes
   are fetched and the common lengths to the left and right of the anchor tell which strings repeat.
   A class of over ``WIDE`` different neighbourhoods would be too much for one task. Its members' strings
   are hashed instead (128 bits) and meet by hash; a task sends each string once, so that a string that
   a third of all documents share does not gather in one place. A run that alone has over ``RUN_WIDE``
   of a class sends one of them as a mark that makes the class wide, so the merge gets few of it too.
4. Spans are united for each document.

Neighbourhoods and strings are hashed by XXH3 to 128 bits, which no repetitive form of a text defeats.

The number of buckets and tasks follows the bytes of text (``tasks_for``), not a setting.

Copies inside a run are collapsed before the exchange, and equal spans once more before they are joined. A document is
known by its id and a 64-bit hash of its text (a null id is replaced by a second hash), so repeated rows each
count and each get the same result.

Edge cases: a null text is empty; texts shorter than ``least`` bytes hold no string and stay whole; ids are of any
type, null ids are allowed; ties cannot matter, as all of several equal strings go; a very long text is cut into sections for the
search and is whole only where it is read and written; text that repeats itself has an anchor at each byte, so runs are bounded by suffixes too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, release, size_shuffles, tasks_for
from .textkit import Slab, bound_batches, lists, map_batches, mix, prefix_hash, range_hash, slabs

LEAST, GRAM, WINDOW = 200, 16, 128
SEED = 0x6C656374
RUN_BYTES = 12 << 20
#: Bytes of a long text that are looked at together, and suffixes of a run at most: text that repeats itself has an anchor at each byte.
SECTION, RUN_SUFFIXES = 1 << 20, 250_000
#: Bytes of text from which on the runs' shuffle is worth a second of cleaning.
RELEASED = 64 << 20
#: Classes of at most so many members are compared pair by pair, larger ones by hashes of their strings.
PAIRED = 12
#: Members of larger classes that are looked at together.
HELD = 8192
#: Different neighbourhoods beyond which a class is spread over all tasks. The lowest bit of a class tells.
WIDE, RUN_WIDE = 2048, 32


def pack(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps([a.tobytes() if isinstance(a, np.ndarray) else a for a in arrays], protocol=5), 1)


def unpack(blob: bytes, *kinds) -> list:
    return [np.frombuffer(x, k) if k else x for x, k in zip(pickle.loads(zstandard.decompress(blob)), kinds)]


def sliding(h: np.ndarray, w: int, op, fill: int) -> np.ndarray:
    """``op`` (minimum or maximum) over h[i : i + w] for each i, by running values inside blocks of w."""
    n = len(h)
    size = -(-(n + w) // w) * w
    padded = np.full(size, fill, h.dtype)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


class Shape:
    """Lengths that follow from ``least``: of the key, and of what lies before and behind it."""

    def __init__(self, least: int, gram: int, window: int, wide: int = WIDE, run_wide: int = RUN_WIDE):
        if window + gram - 1 > least:
            raise ValueError("a string must hold a whole window")
        self.least, self.gram, self.window, self.wide, self.run_wide = least, gram, window, wide, run_wide
        self.before = window - 1
        self.key = least - self.before


def anchors(slab: Slab, prefix: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions of a slab and the hash of the bytes at each."""
    n = len(slab.buf)
    if n < s.least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - s.gram + 1)
    h = np.maximum(range_hash(prefix, at, at + s.gram), np.uint64(1))
    least = sliding(h, s.window, np.minimum, 2**64 - 1)
    # windows that cross a text's end are none
    size = np.diff(slab.offs)
    ends, long_enough = np.repeat(slab.offs[1:], size), np.repeat(size >= s.least, size)
    whole = at + s.window + s.gram - 1 <= ends[: len(at)]
    least[~whole] = 0
    # a position is least in some window if it equals the largest of the windows' least values
    most = sliding(least[::-1], s.window, np.maximum, 0)[::-1]
    pick = np.flatnonzero((h == most) & (at + s.key <= ends[: len(at)]) & long_enough[: len(at)])
    return pick, h[pick]


def sections(slab: Slab, s: Shape, size: int = SECTION):
    """A slab as it is, or a long text cut up: (part, its place in the text, first and last place whose anchors count).

    Parts reach so far over both ends that all windows, keys and neighbourhoods of their own anchors lie inside.
    """
    n = len(slab.buf)
    if slab.hi - slab.lo > 1 or n <= 2 * size:
        yield slab, 0, 0, n
        return
    for x in range(0, n, size):
        a, b = max(0, x - s.window), min(n, x + size + s.least + s.window + s.gram)
        yield slab._replace(buf=slab.buf[a:b], offs=np.array([0, b - a])), a, x - a, min(x + size, n) - a


def suffixes(slab: Slab, ids: np.ndarray, marks: np.ndarray, s: Shape):
    """The columns of a run (key, hashes, id, mark, place, neighbourhood) for the anchors of a slab, ``RUN_SUFFIXES`` at most at once."""
    for part, base, first, last in sections(slab, s):
        prefix = prefix_hash(part.buf)
        found, _ = anchors(part, prefix, s)
        found = found[(found >= first) & (found < last)]
        for k in range(0, len(found), RUN_SUFFIXES):
            at = found[k : k + RUN_SUFFIXES]
            row = np.searchsorted(part.offs, at, "right") - 1
            begin, end = part.offs[:-1][row], part.offs[1:][row]
            low, high = np.maximum(begin, at - s.before), np.minimum(end, at + s.least)
            where = range_hash(prefix, at, at + s.key)
            local = base - begin
            yield (
                sliding_window_view(part.buf, s.key)[at], where, *neighbourhoods(part, at, low, high), ids[part.lo + row], marks[part.lo + row],
                (at + local).astype(np.int32), (low + local).astype(np.int32), (high + local).astype(np.int32),
            )


def united(ids: np.ndarray, mark: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Spans by document, those that overlap or touch as one."""
    ids, mark, low, high = unique_rows(high, low, mark, ids)[::-1]
    if not len(ids):
        return [ids, mark, low, high]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (mark[1:] != mark[:-1])
    # the furthest end so far in the document: documents are kept apart by a step that no place reaches
    step = np.cumsum(new).astype(np.int64) << 40
    far = np.maximum.accumulate(step + high)
    new[1:] |= step[1:] + low[1:] > far[:-1]
    at = np.flatnonzero(new)
    return [ids[at], mark[at], low[at], np.maximum.reduceat(high, at)]


def digests(data: bytes, low: list[int], high: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each of some ranges of bytes, as two columns."""
    own = b"".join([xxhash.xxh3_128_digest(data[a:b], SEED) for a, b in zip(low, high)])
    return tuple(np.ascontiguousarray(x) for x in np.frombuffer(own, np.uint64).reshape(-1, 2).T)


def neighbourhoods(slab: Slab, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the bytes from ``low`` to ``high`` around each anchor, and of where it lies in them."""
    before = mix((at - low).astype(np.uint64) + np.uint64(1))
    one, two = digests(slab.buf.tobytes(), low.tolist(), high.tolist())
    return mix(one + before), mix(two ^ before)


def make_run(parts: list[tuple], buckets: int, s: Shape) -> list[tuple[int, bytes]]:
    """Sort, collapse and front-code the suffixes of some slabs; blobs by bucket, and the spans found already."""
    keys = np.concatenate([p[0] for p in parts])
    where, hood, hood2, ids, mark, pos, low, high = (np.concatenate([p[k] for p in parts]) for k in range(1, 9))
    if not len(keys):
        return []
    raw = keys.tobytes()
    texts = [raw[i : i + s.key] for i in range(0, len(raw), s.key)]
    order = np.array(sorted(range(len(texts)), key=texts.__getitem__))
    bucket = (where % np.uint64(buckets)).astype(np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    del texts
    keys = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(1)
    group = np.cumsum(new)
    order = order[np.lexsort((hood2[order], hood[order], group))]  # keys of a group are equal, so they stay as they are
    hood, hood2, ids, mark, pos, low, high, bucket = (x[order] for x in (hood, hood2, ids, mark, pos, low, high, bucket))
    first = new.copy()
    first[1:] |= (hood[1:] != hood[:-1]) | (hood2[1:] != hood2[:-1])
    size = np.diff(np.append(np.flatnonzero(first), len(first)))
    many = np.repeat(size, size) > 1
    done = united(*[x[many] for x in (ids, mark, low, high)])
    keys, state, group = keys[first], (size > 1).astype(np.uint8), group[first]
    hood, hood2, ids, mark, pos, low, high, bucket = (x[first] for x in (hood, hood2, ids, mark, pos, low, high, bucket))
    # a class that is large already goes the wide way; one member stays as the mark of it
    hot = np.bincount(group)[group] > s.run_wide
    wide = [x[hot] for x in (ids, mark, pos)]
    lead = np.diff(group, prepend=-1) > 0
    state[hot] |= 2
    keep = ~hot | lead
    keys, hood, hood2, ids, mark, pos, low, high, bucket, state = (x[keep] for x in (keys, hood, hood2, ids, mark, pos, low, high, bucket, state))
    out = []
    if len(done[0]) or len(wide[0]):
        # a key of its own, so that these spread over the tasks like the buckets
        out.append((-1 - int(hood[0] >> np.uint64(2)), pack(*done, *wide)))
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(bucket))):
        part = keys[a:b]
        common = np.zeros(b - a, np.uint8)
        differ = part[1:] != part[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), s.key)
        rest = part[np.arange(s.key) >= common[:, None]]
        out.append((int(bucket[a]), pack(common, rest, hood[a:b], hood2[a:b], ids[a:b], mark[a:b], pos[a:b], low[a:b], high[a:b], state[a:b])))
    return out


def unique_rows(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of some columns."""
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [c[new] for c in columns]


def merge(runs: list[tuple[list[int], bytes]], width: int) -> tuple[list[int], list[int]]:
    """Merge front-coded runs by a loser tree; each output's run, and its common prefix with the one before.

    ``h[r]`` is the common prefix of run r's head with the last output. Of two heads the one with the
    larger value is smaller; only where they are equal are bytes compared, from there on.
    """
    k = len(runs)
    common = [r[0] for r in runs]
    rest = [r[1] for r in runs]
    count = [len(c) for c in common]
    at, byte = [0] * k, [width] * k
    head = [r[:width] for r in rest]
    h = [0 if n else -1 for n in count]
    size = 1 << max(0, k - 1).bit_length()
    tree = [-1] * (2 * size)

    def play(a: int, b: int) -> tuple[int, int]:
        if b < 0 or a >= 0 and h[a] > h[b]:
            return a, b
        if a < 0 or h[b] > h[a]:
            return b, a
        low = h[a]
        if low < 0:
            return a, b
        x, y = head[a][low:], head[b][low:]
        if x == y:
            h[b] = width
            return a, b
        differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        both = width - (differ.bit_length() + 7) // 8
        if x < y:
            h[b] = both
            return a, b
        h[a] = both
        return b, a

    best = [-1] * (2 * size)
    for r in range(k):
        best[size + r] = r
    for node in range(size - 1, 0, -1):
        best[node], tree[node] = play(best[2 * node], best[2 * node + 1])
    winner = best[1]
    out_run, out_common = [], []
    for _ in range(sum(count)):
        out_run.append(winner)
        out_common.append(h[winner])
        i = at[winner] + 1
        at[winner] = i
        if i < count[winner]:
            c = common[winner][i]
            b = byte[winner]
            e = b + width - c
            head[winner] = head[winner][:c] + rest[winner][b:e]
            byte[winner] = e
            h[winner] = c
        else:
            h[winner] = -1
        node = (size + winner) >> 1
        hw = h[winner]
        while node:
            other = tree[node]
            if other >= 0:
                ho = h[other]
                if ho > hw:
                    tree[node], winner, hw = winner, other, ho
                elif ho == hw and ho >= 0:
                    first, second = play(winner, other)
                    tree[node], winner = second, first
                    hw = h[winner]
            node >>= 1
    return out_run, out_common


def by_document(ids: np.ndarray, mark: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Group rows by document: its id and mark, the first row of each, and the columns in that order."""
    order = np.lexsort((mark, ids))
    ids, mark = ids[order], mark[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (mark[1:] != mark[:-1])
    first = np.flatnonzero(new)
    return ids[first], mark[first], np.append(first, len(ids)), [c[order] for c in columns]


SPOTS = "id long, mark long, low array<int>, high array<int>, pos array<int>, cls array<long>"


def merge_bucket(bucket: int, blobs: list[bytes], s: Shape) -> pa.Table:
    """Covered spans, and the anchors whose neighbourhood must be compared, by document."""
    if bucket < 0:
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int32)
        ids, mark, low, high, *wide = (np.concatenate(x) for x in zip(*[unpack(b, *kinds) for b in blobs]))
        need = (*wide, np.ones(len(wide[0]), np.int64))
    else:
        runs = [unpack(b, np.uint8, None, np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8) for b in blobs]
        came, common = merge([(r[0].tolist(), r[1]) for r in runs], s.key)
        came = np.array(came)
        # an output's row: the rows of each run come out in their order
        start = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
        row = np.empty(len(came), np.int64)
        order = np.argsort(came, kind="stable")
        row[order] = np.arange(len(came))
        assert start[-1] == len(came)
        hood, hood2, ids, mark, pos, low, high, state = (np.concatenate([r[k] for r in runs])[row] for k in range(2, 10))
        group = np.cumsum(np.array(common) < s.key)
        order = np.lexsort((pos, mark, ids, hood2, hood, group))
        group, hood, hood2, ids, mark, pos, low, high, state = (x[order] for x in (group, hood, hood2, ids, mark, pos, low, high, state))
        first = np.ones(len(group), bool)
        first[1:] = (group[1:] != group[:-1]) | (hood[1:] != hood[:-1]) | (hood2[1:] != hood2[:-1])
        size = np.diff(np.append(np.flatnonzero(first), len(first)))
        covered = (np.repeat(size, size) > 1) & (state & 1 == 0)  # those of a run are known already
        distinct = np.bincount(group[first], minlength=int(group[-1]) + 1)
        wide = np.bincount(group, weights=state & 2, minlength=int(group[-1]) + 1) > 0
        wide |= distinct > s.wide
        wanted = first & ((distinct > 1) | wide)[group]
        cls = (np.int64(bucket) << np.int64(40)) + (group[wanted].astype(np.int64) << np.int64(1)) + wide[group[wanted]]
        need = (ids[wanted], mark[wanted], pos[wanted], cls)
        ids, mark, low, high = united(*[x[covered] for x in (ids, mark, low, high)])
    return pa.concat_tables([_rows(ids, mark, low=low, high=high), _rows(need[0], need[1], pos=need[2], cls=need[3])])


def _rows(ids: np.ndarray, mark: np.ndarray, **columns: np.ndarray) -> pa.Table:
    key, own, first, made = by_document(ids, mark, *columns.values())
    named = dict(zip(columns, made))
    none = np.zeros(len(key) + 1, np.int64)
    kinds = {"low": pa.int32(), "high": pa.int32(), "pos": pa.int32(), "cls": pa.int64()}
    data = {c: lists(named.get(c, np.zeros(0, np.int64)), first if c in named else none, k) for c, k in kinds.items()}
    return pa.table({"id": pa.array(key, pa.int64()), "mark": pa.array(own, pa.int64())} | data)


def strings_over(data: np.ndarray, pos: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all strings over some anchors of a text, and two hashes of each."""
    mark = np.zeros(len(data) + 2, np.int32)
    np.add.at(mark, np.maximum(pos - s.before, 0), 1)
    np.add.at(mark, np.minimum(pos, len(data) - s.least) + 1, -1)
    start = np.flatnonzero(np.cumsum(mark) > 0)
    return start.astype(np.int32), *digests(data.tobytes(), start.tolist(), (start + s.least).tolist())


def collapse(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal strings together, the first of each, and how often each row's string occurs."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    first = np.ones(len(order), bool)
    first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    size = np.diff(np.append(np.flatnonzero(first), len(order)))
    return order, first, np.repeat(size, size)


def string_blobs(parts: list[tuple], buckets: int) -> list[tuple[int, bytes]]:
    """Strings of a batch by bucket: one of each goes on; those that the batch repeats are spans already."""
    if not parts:
        return []
    ids, mark, start, one, two = (np.concatenate(x) for x in zip(*parts))
    order, first, times = collapse(one, two)
    ids, mark, start, one, two = (x[order] for x in (ids, mark, start, one, two))
    again, out = times > 1, []
    if again.any():
        out.append((-1 - int(mix(one[again][:1])[0] >> np.uint64(40)), pack(ids[again], mark[again], start[again])))
    ids, mark, start, one, two, again = (x[first] for x in (ids, mark, start, one, two, again))
    bucket = (two % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for rows in np.split(order, cut[1:]):
        out.append((buckets + int(bucket[rows[0]]), pack(ids[rows], mark[rows], start[rows], one[rows], two[rows], again[rows])))
    return out


def repeated_strings(bucket: int, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id, mark and start of the strings of a bucket that occur at two places or more."""
    kinds = (np.int64, np.int64, np.int32, np.uint64, np.uint64, bool)
    columns = [np.concatenate(x) for x in zip(*[unpack(b, *kinds) for b in blobs])]
    if bucket < 0:
        return columns[0], columns[1], columns[2]
    ids, mark, start, one, two, again = columns
    order, _, times = collapse(one, two)
    keep = order[(times > 1) & ~again[order]]  # those that a batch repeats are known already
    return ids[keep], mark[keep], start[keep]


def padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, and their lengths."""
    size = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(-1, width), size


def resolve(cls: np.ndarray, left: list[bytes], right: list[bytes], s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """How far the repeated strings over each anchor reach before it and behind its key; -1 where there is none.

    ``left`` holds the bytes before the anchor, nearest first.
    """
    n, w = len(cls), s.before
    most_left, most_right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    order = np.argsort(cls, kind="stable")
    cut = np.flatnonzero(np.diff(cls[order], prepend=cls[order][0] - 1)) if n else np.zeros(0, int)
    size = np.diff(np.append(cut, n))
    L, ln = padded(left, w)
    R, rn = padded(right, w)
    small = [order[a : a + m] for a, m in zip(cut, size) if 1 < m <= PAIRED]
    if small:
        pairs = []
        for m in sorted({len(x) for x in small}):
            rows = np.stack([x for x in small if len(x) == m])
            i, j = np.triu_indices(m, 1)
            pairs.append((rows[:, i].ravel(), rows[:, j].ravel()))
        x, y = (np.concatenate(p) for p in zip(*pairs))
        for k in range(0, len(x), 1 << 16):
            a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            l, r = (np.minimum(common_length(M[a], M[b]), np.minimum(z[a], z[b])) for M, z in ((L, ln), (R, rn)))
            ok = l + r >= w
            for rows in (a[ok], b[ok]):
                np.maximum.at(most_left, rows, l[ok])
                np.maximum.at(most_right, rows, r[ok])
    # a pair's strings are one span; of several pairs, the furthest reach to each side is reached, as all hold the key
    held, rows = [], 0
    large = [(a, m) for a, m in zip(cut, size) if m > PAIRED]
    for n_class, (a, m) in enumerate(large):
        held.append((np.full(m, n_class), order[a : a + m]))
        rows += m
        if rows >= HELD or n_class + 1 == len(large):
            label, own = (np.concatenate(x) for x in zip(*held))
            for k, found in string_repeats(label, own, L, ln, R, rn, w):
                np.maximum.at(most_left, found, k)
                np.maximum.at(most_right, found, w - k)
            held, rows = [], 0
    return most_left, most_right


def common_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def string_repeats(label: np.ndarray, rows: np.ndarray, L: np.ndarray, ln: np.ndarray, R: np.ndarray, rn: np.ndarray, w: int):
    """For each k, the rows whose string of k bytes before the anchor occurs at another row of their class too."""

    def ranks(M: np.ndarray, now: np.ndarray):
        # equal for rows of one class that agree in their first k bytes, for k = 0, 1, ..., w
        yield now
        for k in range(w):
            now = np.unique(now.astype(np.int64) * 256 + M[:, k], return_inverse=True)[1].astype(np.int32)
            yield now

    left, right = list(ranks(L[rows], label.astype(np.int32))), list(ranks(R[rows], np.zeros(len(rows), np.int32)))
    for k in range(w + 1):
        ok = np.flatnonzero((ln[rows] >= k) & (rn[rows] >= w - k))
        key = left[k][ok].astype(np.int64) * (len(rows) + 1) + right[w - k][ok]
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        yield k, rows[ok[times[inverse] > 1]]


def spread(cls: int, buckets: int) -> int:
    """The bucket in which the members of a class meet."""
    return int((cls * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20) % buckets


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, window: int = WINDOW, run_bytes: int = RUN_BYTES, wide: int = WIDE, run_wide: int = RUN_WIDE) -> DataFrame:
    """``doc_id``, ``text``, ``removed`` (spans of bytes, end exclusive, sorted, apart) and ``kept`` (the other bytes)."""
    spark = docs.sparkSession
    bound_batches(spark)
    s = Shape(least, gram, window, wide, run_wide)
    kind = docs.schema[doc_id].dataType
    known = F.col(doc_id).cast("long") if isinstance(kind, T.IntegralType) else F.when(F.col(doc_id).isNotNull(), F.xxhash64(F.lit(1), doc_id))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(known, F.xxhash64(F.lit(2), text)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    n_bytes = keyed.select(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = tasks_for(n_bytes)
    buckets = 8 * tasks  # several for each task, so that tasks are of like size
    size_shuffles(spark, n_bytes)

    def runs(batches):
        held, size, count = [], 0, 0
        for batch in batches:
            ids, marks = (batch.column(n).to_numpy() for n in ("id", "mark"))
            for slab in slabs(batch.column("text")):
                for made in suffixes(slab, ids, marks, s):
                    held.append(made)
                    count += len(made[0])
                    if count >= RUN_SUFFIXES:
                        yield from blobs(held)
                        held, size, count = [], 0, 0
                size += len(slab.buf)
                if size >= run_bytes:
                    yield from blobs(held)
                    held, size, count = [], 0, 0
        yield from blobs(held)

    def blobs(held):
        made = make_run(held, buckets, s) if held else []
        for k in range(0, len(made), 64):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made[k : k + 64]], pa.int64()), pa.array([x[1] for x in made[k : k + 64]], pa.binary())], names=["bucket", "blob"])

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        return merge_bucket(key[0].as_py(), table.column("blob").to_pylist(), s)

    spots = materialise(keyed.select("id", "mark", "text").mapInArrow(runs, "bucket long, blob binary").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(merged, SPOTS), "spots")
    if n_bytes >= RELEASED:  # the runs are merged
        release(spark)

    def gathered(rows: DataFrame, *names: str) -> DataFrame:
        # of copies each run gives the same few spans, so a document gets no more of them than there are runs
        return rows.groupBy("id", "mark").agg(*[F.flatten(F.collect_list(n)).alias(n) for n in names])

    need = gathered(spots.where("size(pos) > 0"), "pos", "cls")
    fetched_schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("blob", T.BinaryType())])

    def fetch(batch: pa.RecordBatch) -> dict:
        ids, marks, texts = (batch.column(n).to_pylist() for n in ("id", "mark", "text"))
        where: dict[int, list] = {}
        strings, seen = [], set()
        for i, m, t, pos, cls in zip(ids, marks, texts, batch.column("pos").to_pylist(), batch.column("cls").to_pylist()):
            if (i, m) in seen:  # a row that repeats another
                continue
            seen.add((i, m))
            data = t.encode()
            if wide := [p for p, c in zip(pos, cls) if c & 1]:
                start, one, two = strings_over(np.frombuffer(data, np.uint8), np.array(wide), s)
                strings.append((np.full(len(start), i, np.int64), np.full(len(start), m, np.int64), start, one, two))
            for p, c in zip(pos, cls):
                if c & 1:
                    continue
                where.setdefault(spread(c, buckets), []).append((c, i, m, p, data[max(0, p - s.before) : p][::-1], data[p + s.key : p + s.least]))
        packed = []
        for own in where.values():
            own.sort(key=lambda x: x[0])  # neighbours of a class look alike and pack well
            cls, i, m, p, left, right = zip(*own)
            packed.append(pack(np.array(cls, np.int64), np.array(i, np.int64), np.array(m, np.int64), np.array(p, np.int32), list(left), list(right)))
        more = string_blobs(strings, buckets)
        return {"bucket": [*where, *(k for k, _ in more)], "blob": [*packed, *(b for _, b in more)]}

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if not 0 <= bucket < buckets:
            ids, mark, start = repeated_strings(bucket, table.column("blob").to_pylist())
            return _rows(ids, mark, low=start, high=start + np.int32(s.least)).select(["id", "mark", "low", "high"])
        cls, ids, mark, pos, left, right = zip(*[unpack(b, np.int64, np.int64, np.int64, np.int32, None, None) for b in table.column("blob").to_pylist()])
        cls, ids, mark, pos = (np.concatenate(x) for x in (cls, ids, mark, pos))
        l, r = resolve(cls, [x for y in left for x in y], [x for y in right for x in y], s)
        ok = l >= 0
        return _rows(ids[ok], mark[ok], low=pos[ok] - l[ok].astype(np.int32), high=pos[ok] + s.key + r[ok].astype(np.int32)).select(["id", "mark", "low", "high"])

    exact = map_batches(keyed.join(need, ["id", "mark"]), fetch, fetched_schema).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(compare, "id long, mark long, low array<int>, high array<int>")
    covered = gathered(spots.where("size(low) > 0").select("id", "mark", "low", "high").unionByName(exact), "low", "high")
    out_schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("kept", T.BinaryType())])

    def remove(batch: pa.RecordBatch) -> dict:
        spans, kept = [], []
        for t, low, high in zip(batch.column("text").to_pylist(), batch.column("low").to_pylist(), batch.column("high").to_pylist()):
            data = t.encode()
            if not low:
                spans.append([])
                kept.append(data)
                continue
            mark = np.zeros(len(data) + 1, np.int32)
            np.add.at(mark, low, 1)
            np.add.at(mark, high, -1)
            gone = np.cumsum(mark[:-1]) > 0
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            spans.append(edge.reshape(-1, 2).tolist())
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "removed": spans, "kept": pa.array(kept, pa.binary())}

    return map_batches(keyed.join(covered, ["id", "mark"], "left"), remove, out_schema)
