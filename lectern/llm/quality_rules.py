"""Quality rules with suffix-array repetition, one text at a time, all texts of a slab at once.

The suffix array runs over words and is built by prefix doubling; suffixes leave as soon as their rank
is settled. The ranks stored at each depth give the longest common prefixes (LCP) of neighbours. A suffix's deepest LCP interval is its longest
repeat; repeats that extend to the left are dropped, which leaves the maximal repeated substrings.
Their spans are united; a text is rejected if they cover too much of it or one is too long.

Edge cases: a null, empty or blank text has no words and fails the base rules; ties and repeated rows
are judged alike; an empty table gives an empty result. Other columns pass through; the operator's
columns replace columns of the same name. Words are told apart byte by byte. A very long text is a slab
by itself, so memory follows the longest text; time grows with n log n of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import NONSPACE, Slab, Words, bound_batches, find_words, map_batches, slabs, word_numbers

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BLANK = b" \t\n\v\f\r"

FIELDS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()),
    ("n_maximal_repeats", T.LongType()), ("repeat_covered_words", T.LongType()), ("repeat_covered_chars", T.LongType()), ("longest_repeat_words", T.LongType()), ("kept", T.BooleanType()),
]


class Repeats:
    """Suffix array, LCPs and longest repeats of the texts of a slab, given the numbers of their words."""

    def __init__(self, numbers: np.ndarray, first: np.ndarray, min_words: int):
        n = len(numbers)
        self.doc = doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.longest = np.zeros(n, np.int64)
        if not n:
            return
        # ranks by one word: those of different texts differ, so that no group spans two texts
        key = doc * (numbers.max() + 1) + numbers
        order = np.argsort(key, kind="stable")
        rank, open_ = self._groups(order, key[order], np.zeros(n, np.int64))
        levels, depth = [], 1
        while True:
            levels.append((depth, rank))
            if not len(open_):
                break
            then = np.minimum(open_ + depth, n - 1)
            inside = (open_ + depth < n) & (doc[then] == doc[open_])
            key = rank[open_] * np.int64(n + 1) + np.where(inside, rank[then] + 1, 0)
            order = np.argsort(key, kind="stable")
            rank, open_ = self._groups(open_[order], key[order], rank)
            depth *= 2
        array = np.empty(n, np.int64)
        array[rank] = np.arange(n)
        # LCPs of neighbours from the stored ranks, where they can reach min_words
        reach = [r for h, r in levels if h <= min_words][-1]
        at = np.flatnonzero(reach[array[1:]] == reach[array[:-1]])
        a, b = array[at].copy(), array[at + 1].copy()
        home, both = doc[a], np.zeros(len(at), np.int64)
        for h, r in reversed(levels):
            ok = (a < n) & (b < n)
            ok[ok] = (r[a[ok]] == r[b[ok]]) & (doc[a[ok]] == home[ok]) & (doc[b[ok]] == home[ok])
            for x in (a, b, both):
                x[ok] += h
        lcp = np.zeros(n + 1, np.int64)
        lcp[at + 1] = both
        lcp[lcp < min_words] = 0
        # the deepest LCP interval that holds a suffix has the larger LCP of its two sides
        self.longest[array] = np.maximum(lcp[:-1], lcp[1:])

    @staticmethod
    def _groups(order: np.ndarray, key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks after ``order`` was sorted by ``key`` inside its old groups; the suffixes still tied."""
        n = len(order)
        new = np.ones(n + 1, bool)
        new[1:n] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(begin)
        lead = np.repeat(begin[:-1], size)
        old = rank[order]
        fresh = np.ones(n, bool)
        fresh[1:] = old[1:] != old[:-1]
        base = np.repeat(np.flatnonzero(fresh), np.diff(np.append(np.flatnonzero(fresh), n)))
        out = rank.copy()
        out[order] = old + lead - base
        return out, order[np.repeat(size, size) > 1]


def cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Marks of the words inside any of the spans."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0


def per_text(marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[first[1:]] - total[first[:-1]]


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and (x[0] > 32 or x.strip(BLANK))]
    return len(lines) - len(set(lines))


def measure(slab: Slab, window: int, min_words: int) -> dict[str, np.ndarray]:
    words: Words = find_words(slab, NONSPACE)
    n, first = len(words.start), words.first
    numbers, _ = word_numbers(slab, words, NONSPACE, lower=False)
    starts_char = np.concatenate([[0], np.cumsum((slab.buf & 0xC0) != 0x80)]).astype(np.int64)
    chars = starts_char[words.end] - starts_char[words.start]
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[slab.buf])])
    found = Repeats(numbers, first, min(window, min_words))
    at = np.flatnonzero(found.longest >= window)
    repeat = cover(at, np.full(len(at), window), n)
    # a repeat that starts one word earlier and ends at the same place makes this one not maximal
    deep = np.where(found.longest >= min_words, found.longest, 0)
    before = np.concatenate([[0], deep[:-1]])
    maximal = np.flatnonzero((deep > 0) & (before < deep + 1))
    longest = np.zeros(len(first) - 1, np.int64)
    np.maximum.at(longest, found.doc[maximal], deep[maximal])
    marks = np.zeros(n, bool)
    marks[maximal] = True
    covered = cover(maximal, deep[maximal], n)
    return {
        "n_words": np.diff(first), "word_chars": per_text(chars, first), "n_symbols": symbols[slab.offs[1:]] - symbols[slab.offs[:-1]],
        "n_dup_lines": np.array([repeated_lines(slab.text(k)) for k in range(slab.hi - slab.lo)], np.int64), "n_repeat_words": per_text(repeat, first),
        "n_maximal_repeats": per_text(marks, first), "repeat_covered_words": per_text(covered, first), "repeat_covered_chars": per_text(np.where(covered, chars, 0), first), "longest_repeat_words": longest,
    }


def quality_rules(docs: DataFrame, *, text: str = "text", window: int = 5, min_words: int = 5, least_words: int = 10, most_repeat_percent: int = 20, most_covered: float = 0.2, longest: int = 100) -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept`` to ``docs``.

    ``kept`` is false if the base rules fail, if maximal repeats of ``min_words`` words or more cover
    over ``most_covered`` of the characters in words, or if one of them is longer than ``longest`` words.
    """
    bound_batches(docs.sparkSession)
    base = docs.drop(*[n for n, _ in FIELDS])
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, t) for n, t in FIELDS]])

    def judge(batch: pa.RecordBatch) -> dict:
        parts = [measure(s, window, min_words) for s in slabs(batch.column(text))]
        x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        x["base_failed"] = (x["n_words"] < least_words) | (100 * x["n_repeat_words"] > most_repeat_percent * x["n_words"])
        x["kept"] = ~x["base_failed"] & (x["repeat_covered_chars"] <= most_covered * x["word_chars"]) & (x["longest_repeat_words"] <= longest)
        return {name: batch.column(name) for name in batch.schema.names} | x

    return map_batches(base, judge, schema)

