"""Sections of a video by change points in its captions' embeddings.

A kernel cost (RBF, bandwidth by the median distance) over all spans of a video's frames; the optimal
partition with a penalty by pruned dynamic programming (PELT: Killick, Fearnhead and Eckley 2012), or
binary segmentation where the number of sections is given. One video is one group, and its memory grows with the number of
its frames: kernels are summed block by block as the search goes on and never kept, and the exact median
distance is found by counting.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "video_id string, section_id string, start int, end int, frames array<string>, text string"


#: Frames whose kernels with all others are made at once, and most distances that are kept to be sorted.
BLOCK, KEPT = 128, 1 << 20


def median_distance(x: np.ndarray, square: np.ndarray) -> float:
    """The median of all squared distances, exactly: ranges that hold it are narrowed by counting, and the last one is sorted."""
    n = len(x)
    pairs = n * (n - 1) // 2
    if not pairs:
        return 0.0

    def distances():
        for a in range(0, n, BLOCK):
            b = min(a + BLOCK, n)
            d = np.maximum(square[a:b, None] + square[None, a:] - 2 * (x[a:b] @ x[a:].T), 0)
            yield d[np.arange(n - a)[None, :] > np.arange(b - a)[:, None]]

    top = 4 * float(square.max()) + 1e-9
    low, high, before, inside = 0.0, top, 0, pairs  # the range, those below it and those in it
    wanted = ((pairs - 1) // 2, pairs // 2)
    while inside > KEPT and high - low > 1e-14 * top:
        edges = np.linspace(low, high, 4097)
        counts = np.zeros(4096, np.int64)
        for d in distances():
            own = d[(d >= low) & (d < high)]
            counts += np.bincount(np.searchsorted(edges, own, "right") - 1, minlength=4096)[:4096]
        ends = before + np.cumsum(counts)
        first, last = (int(np.searchsorted(ends, w, "right")) for w in wanted)
        low, high, before, inside = edges[first], edges[last + 1], int(ends[first] - counts[first]), int(ends[last] - ends[first] + counts[first])
    if inside > KEPT:
        return low
    found = np.sort(np.concatenate([d[(d >= low) & (d < high)] for d in distances()]))
    return float((found[wanted[0] - before] + found[wanted[1] - before]) / 2)


class RbfCost:
    """Cost of a span: its length less the mean of its kernel. Spans are asked for in order of their ends, in memory linear in the frames."""

    def __init__(self, x: np.ndarray):
        self.x = x - x.mean(0)
        self.square = (self.x * self.x).sum(1)
        self.middle = median_distance(self.x, self.square)
        self.restart(0)

    def restart(self, first: int) -> None:
        """Spans from ``first`` on, from their shortest."""
        self.first = self.end = first
        self.sums = np.zeros(len(self.x) + 1)  # of the kernels within [s, end), by s

    def kernels(self, a: int, b: int, low: int, high: int) -> np.ndarray:
        """Kernels of the frames from a to b with those from low to high."""
        d = np.maximum(self.square[a:b, None] + self.square[None, low:high] - 2 * (self.x[a:b] @ self.x[low:high].T), 0)
        k = np.exp(-np.clip(d / self.middle if self.middle else d, 1e-2, 1e2))
        same = np.arange(max(a, low), min(b, high))
        k[same - a, same - low] = 1
        return k

    def advance(self, end: int) -> None:
        while self.end < end:
            a, b = self.end, min(self.end + BLOCK, end)
            k = self.kernels(a, b, self.first, b)
            old, new = k[:, : a - self.first], k[:, a - self.first :]
            self.sums[self.first : a] += 2 * old.sum(0)[::-1].cumsum()[::-1] + new.sum()
            # sums over both sides from s on, for s among the new ones
            self.sums[a:b] = np.diagonal(new[::-1, ::-1].cumsum(0).cumsum(1))[::-1]
            self.end = b

    def keep_from(self, first: int) -> None:
        """No span that starts before is asked for again."""
        self.first = max(self.first, first)

    def __call__(self, a: int, b: int) -> float:
        if b < self.end or a < self.first:
            self.restart(a)
        self.advance(b)
        return (b - a) - self.sums[a] / (b - a)

    def splits(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Costs of [a, k) and of [k, b) for k from a to b; nothing costs nothing."""
        self.restart(a)
        self.advance(b)
        size = np.arange(b - a + 1)
        behind = np.append(self.sums[a:b], 0.0)
        # what lies before k: the whole, less what lies behind, less twice what crosses k
        ahead = np.zeros(b - a + 1)
        for p in range(a, b, BLOCK):
            q = min(p + BLOCK, b)
            k = self.kernels(p, q, a, q)
            below = k[:, : p - a].sum(1)
            within = np.tril(k[:, p - a :], -1).sum(1)
            ahead[p - a + 1 : q - a + 1] = 2 * (below + within) + 1
        ahead = ahead.cumsum()
        with np.errstate(divide="ignore", invalid="ignore"):
            left, right = size - ahead / size, size[::-1] - behind / size[::-1]
        return np.where(size > 0, left, 0.0), np.where(size[::-1] > 0, right, 0.0)


def pelt(cost, n: int, penalty: float, min_size: int, jump: int = 5) -> list[int]:
    """Ends of the sections of least total cost plus penalties; all but the last are multiples of ``jump``."""
    ends = [e for e in range(0, n, jump) if e >= min_size] + [n]
    best, last, open_ = {0: 0.0}, {}, [0]
    for e in ends:
        tried = [(best[s] + cost(s, e) + penalty, s) for s in open_ if e - s >= min_size]
        if tried:
            best[e], last[e] = min(tried)
            # a start that is worse even without a further penalty never wins again
            known = {s: v for v, s in tried}
            open_ = [s for s in open_ if s not in known or known[s] - penalty <= best[e]]
        if e in best and e not in open_:
            open_.append(e)
        cost.keep_from(min(open_))
    if n not in last:
        return [n]
    out, e = [], n
    while e:
        out.append(e)
        e = last[e]
    return out[::-1]


def binary_segmentation(cost, n: int, sections: int, min_size: int = 2, jump: int = 5) -> list[int]:
    """Ends of ``sections`` sections, by the best single split each time, as far as splits are possible."""
    ends, found = [n], {}

    def split(a: int, b: int) -> tuple[float, int] | None:
        """The best gain in a section, and where."""
        left, right = cost.splits(a, b)
        places = [k for k in range(a, b, jump) if k - a >= min_size and b - k >= min_size]
        gains = [(left[b - a] if b > a else 0.0) - left[k - a] - right[k - a] for k in places]
        return (gains[best := int(np.argmax(gains))], places[best]) if gains else None

    while len(ends) < sections:
        best = None
        for span in zip([0, *ends[:-1]], ends):
            if span not in found:
                found[span] = split(*span)
            if found[span] and (best is None or found[span][0] > best[0]):
                best = found[span]
        if best is None:
            break
        ends = sorted([*ends, best[1]])
    return ends


def section_ends(x: np.ndarray, min_size: int = 6, penalty: float = 15.0, n_sections: int | None = None) -> list[int]:
    n = len(x)
    if n < max(2 * min_size, 8):
        return [n] if n else []
    cost = RbfCost(x)
    return binary_segmentation(cost, n, n_sections) if n_sections else pelt(cost, n, penalty, min_size)


def sections(captions: DataFrame, min_size: int = 6, penalty: float = 15.0, n_sections: int | None = None) -> DataFrame:
    """Sections from ``video_id``, ``frame``, ``caption`` and ``embedding``: id, start (in), end (out), frames, text.

    A video without any caption is one section.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame", kind="stable")
        names, texts = g["frame"].tolist(), [t.strip() for t in g["caption"].fillna("")]
        ends = section_ends(np.stack([np.asarray(e, float) for e in g["embedding"]]), min_size, penalty, n_sections) if any(texts) else [len(g)]
        rows, a = [], 0
        for k, b in enumerate(ends):
            rows.append((g["video_id"].iloc[0], f"s{k:03d}_{a}_{b}", a, b, names[a:b], " ".join(texts[a:b]).strip()))
            a = b
        return pd.DataFrame(rows, columns=["video_id", "section_id", "start", "end", "frames", "text"])

    return captions.where(F.col("embedding").isNotNull()).select("video_id", "frame", "caption", "embedding").groupBy("video_id").applyInPandas(run, SCHEMA)
