"""SimHash near-duplicates by covering anchors.

1. A text's fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 hashes (seed 42) of its
   3-word shingles, repeats included. Equal fingerprints are one row from here on.
2. Anchors are the words of a covering code of length 64: the perfect Hamming code of 63 bits, of covering radius 1,
   and one free bit. Two fingerprints at a distance of at most ``t`` have a point between them that is at most
   ``ceil(t / 2)`` from both, and that point has an anchor within the covering radius. So each fingerprint is
   replicated to every anchor within the covering radius plus half the threshold, and linked ones meet at one at
   least: no link is lost. The threshold is halved because both sides of a pair are replicated: with all of it on one side each
   fingerprint would have 683 anchors instead of 33.
3. Fingerprints are shuffled by anchor and compared there. For a threshold of 2 an anchor has never more than 2,081
   different fingerprints (the words within a distance of 2), however skewed the data: no group needs splitting.
4. An anchor gives a forest of its links (at most a row for each member), never the pairs. Connected components of all
   forests are the groups.

Edge cases: a null text and one without words have fingerprint zero, linked like any other; a text of fewer than three
words has one shingle of them all; repeated rows each get their row; ids are of any type that can be ordered, a null id
is never the least of its component, and a component of null ids only has a null ``component_id``; ties cannot occur,
as ids that are equal name the same component; a very long text is hashed in blocks of 65,536 shingles by the task of its row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shared import discard, materialise, tasks_for
from .textkit import LOWER, NONSPACE, Slab, bound_batches, find_words, map_batches, slabs

SHINGLE, THRESHOLD, SEED = 3, 2, 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(slab: Slab, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of all texts of a slab, and the first of each text (one entry more than texts)."""
    words = find_words(slab, NONSPACE)
    size = words.end - words.start
    # the words, each with one blank behind it
    begin = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    letters = slab.buf[NONSPACE[slab.buf]]
    joined[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = LOWER[letters]
    count = np.diff(words.first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(words.first[:-1] - first[:-1], made) + np.arange(first[-1])
    last = at + np.repeat(np.minimum(count, n), made) - 1
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    a, b = begin[at].tolist(), (begin[last] + size[last]).tolist()
    return np.fromiter((digest(data[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a)), first


def fold(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint of each text: the bits that are set in over half of its hashes."""
    n = np.diff(first)
    counts = np.zeros((len(n), 64), np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(first, k, "right") - 1, np.searchsorted(first, k + len(part))
        rows = np.arange(lo, hi)
        rows = rows[n[rows] > 0]
        counts[rows] += np.add.reduceat(bits, np.maximum(first[rows] - k, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits, as a signed number) of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [fold(*shingle_hashes(s, n)) for s in slabs(batch.column(1))]
        return {"doc_id": batch.column(0), "fp": np.concatenate(found).view(np.int64)}

    return map_batches(docs.select("doc_id", "text"), run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def anchor_masks(radius: int) -> list[np.ndarray]:
    """For each syndrome, the changes of at most ``radius`` bits that make a code word of a fingerprint.

    Bit b < 63 stands at place b + 1 of the Hamming code, whose syndrome is the exclusive or of the places of its set bits; bit 63 is free.
    """
    found: list[list[int]] = [[] for _ in range(64)]
    for weight in range(radius + 1):
        for bits in combinations(range(64), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= (b + 1) & 63
            found[syndrome].append(sum(1 << b for b in bits))
    return [np.array(x, np.uint64) for x in found]


def syndromes(fps: np.ndarray) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for j in range(6):
        mask = np.uint64(sum(1 << b for b in range(63) if (b + 1) >> j & 1))
        out |= (np.bitwise_count(fps & mask).astype(np.int64) & 1) << j
    return out


def replicate(fps: DataFrame, threshold: int) -> DataFrame:
    """(``anchor``, ``fp``): each fingerprint at every anchor within the covering radius, 1, plus half the threshold."""
    masks = anchor_masks(1 + (threshold + 1) // 2)

    def run(batch: pa.RecordBatch) -> dict:
        own = batch.column(0).to_numpy().view(np.uint64)
        at = syndromes(own)
        anchors, members = [], []
        for s in np.unique(at).tolist():
            part = own[at == s]
            anchors.append((part[:, None] ^ masks[s]).ravel())
            members.append(np.repeat(part, len(masks[s])))
        return {"anchor": np.concatenate(anchors).view(np.int64), "fp": np.concatenate(members).view(np.int64)}

    return map_batches(fps.select("fp"), run, T.StructType([T.StructField("anchor", T.LongType()), T.StructField("fp", T.LongType())]))


def forest(anchor: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and the least member that their links within an anchor lead to; rows are sorted by anchor."""
    left, right, rows = [], [], np.arange(len(fp))
    bits = fp.view(np.uint64)
    for gap in range(1, len(fp)):
        rows = rows[rows + gap < len(fp)]
        rows = rows[anchor[rows] == anchor[rows + gap]]  # those with fewer rows behind them are done
        if not len(rows):
            break
        near = rows[np.bitwise_count(bits[rows] ^ bits[rows + gap]) <= threshold]
        left.append(near)
        right.append(near + gap)
    x, y = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (left, right))
    label = np.arange(len(fp))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(fp)))
    return fp[tied], fp[label[tied]]


TIES = T.StructType([T.StructField("fp", T.LongType()), T.StructField("head", T.LongType())])


def compare(placed: DataFrame, threshold: int) -> DataFrame:
    """Ties within the anchors of ``placed``, which is dealt and sorted by anchor; an anchor cut by a batch is carried over."""

    def run(batches):
        anchor, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            anchor, fp = (np.concatenate([old, new.to_numpy()]) for old, new in zip((anchor, fp), batch.columns))
            if not len(anchor):
                continue
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last may go on
            a, b = forest(anchor[:cut], fp[:cut], threshold)
            anchor, fp = anchor[cut:], fp[cut:]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=TIES.fieldNames())
        a, b = forest(anchor, fp, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=TIES.fieldNames())

    return placed.mapInArrow(run, TIES)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the least id reachable) of every row."""
    if not 0 <= threshold <= 4:
        raise ValueError("a threshold beyond 4 bits needs too many anchors")
    bound_batches(docs.sparkSession)
    prints = materialise(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), n), "fingerprints")
    least = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    replicas = sum(len(m) for m in anchor_masks(1 + (threshold + 1) // 2)) / 64
    tasks = tasks_for(int(least.count() * replicas * 16))
    placed = replicate(least.select("fp"), threshold).repartition(tasks, "anchor").sortWithinPartitions("anchor")
    ties = materialise(compare(placed, threshold).distinct(), "ties")
    groups = components(ties, "fp", "head")
    own = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    own = materialise(own, "members")
    discard(ties, groups, least)
    heads = own.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = own.join(heads, "comp").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")
