"""Quality classifier: document evidence joined with host and path posteriors by hierarchical empirical Bayes.

Document evidence comes from logistic regressions, one per label, on a few shape features and on the
words and word beginnings whose presence is associated with the label. They are trained on the driver on at most
``TRAIN_ROWS`` labelled rows, chosen by a hash of the id; nothing else is bounded.

Site evidence comes from all documents: grouped sums of the document probabilities by host and by path
(all paths of a host under it). A host's rate is shrunk toward the global rate, a path's toward its
host's: posterior = (s * prior + sum) / (s + n), where the strength s comes from the spread of the
rates by the method of moments, so that sparse sites stay near the prior and those with many documents
speak for themselves. A document's final log-odds are its own plus the path's shift from the global
log-odds, times ``site_weight``.

Edge cases: a null or empty text has the features of no words; null hosts and paths are sites like
others; labels of unknown documents or null labels are not used, and a label with one class only gives
its rate; repeated rows are scored alike, and of labelled rows that repeat an id one is learnt from; odds equal
to ``least`` keep the document; a very long text is a slab by itself, so memory follows the longest text; an
empty table gives an empty result. Other columns pass through; the operator's columns replace columns of the
same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, materialise
from .textkit import ALNUM, CODE_LOWER, NONSPACE, Slab, bound_batches, byte_class, find_words, map_batches, mix, range_hash, prefix_hash, slabs

TRAIN_ROWS = 8000
SELECTED = 512
BUCKETS = 1 << 20
LABELS = ("bad", "toxic")
#: Bytes of the word beginnings that count as words too.
STEMS = (4, 5)
SHAPE = ("log_words", "distinct", "mean_length", "symbols", "capitals", "digits", "distinct_lines", "top_word", "nonword")
SYMBOL = byte_class((33, 43), (47, 47), (60, 64), (91, 96), (123, 126))
UPPER, DIGIT = byte_class((65, 90)), byte_class((48, 57))


def features(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape features of each text; the sorted buckets of its distinct words and beginnings, and the first of each text."""
    n = slab.hi - slab.lo
    words = find_words(slab, ALNUM)
    pre = prefix_hash(slab.buf, CODE_LOWER)
    bucket = (range_hash(pre, words.start, words.end) % np.uint64(BUCKETS)).astype(np.int64)
    doc = words.doc
    parts = [doc * BUCKETS + bucket]
    for k in STEMS:
        longer = np.flatnonzero(words.end - words.start > k)
        stem = (range_hash(pre, words.start[longer], words.start[longer] + k) ^ np.uint64(k)) % np.uint64(BUCKETS)
        parts.append(np.unique(doc[longer] * BUCKETS + stem.astype(np.int64)))
    key, times = np.unique(np.concatenate(parts), return_counts=True)
    own = key // BUCKETS
    first = np.searchsorted(own, np.arange(n + 1))
    size = np.diff(slab.offs).astype(float)
    count = np.diff(words.first).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[slab.buf])])
        return (total[slab.offs[1:]] - total[slab.offs[:-1]]) / np.maximum(size, 1)

    top = np.zeros(n)
    np.maximum.at(top, own, times)
    lines = find_words(slab, ~byte_class((10, 10)))
    line_doc = lines.doc
    line_hash = range_hash(pre, lines.start, lines.end)
    keep = np.unique(mix(line_hash ^ (line_doc.astype(np.uint64) << np.uint64(1))), return_index=True)[1]
    distinct_lines = np.bincount(line_doc[keep], minlength=n)
    tokens = find_words(slab, NONSPACE)
    letters = np.bincount(doc, weights=words.end - words.start, minlength=n) if len(doc) else np.zeros(n)
    some = np.maximum(count, 1)
    shape = np.stack([
        np.log1p(count), np.bincount(doc[np.unique(parts[0], return_index=True)[1]], minlength=n) / some**0.8, letters / some / 10, share(SYMBOL) * 10, share(UPPER) * 5, share(DIGIT) * 5,
        distinct_lines / np.maximum(np.diff(lines.first), 1), top / some, np.abs(np.diff(tokens.first) - count) / some,
    ], axis=1)
    return np.clip(shape, -10, 10), key % BUCKETS, first


@dataclass
class Linear:
    """A logistic regression on standardised shape features and on the presence of ``words``."""

    mean: np.ndarray
    scale: np.ndarray
    shape: np.ndarray
    words: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, shape: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = ((shape - self.mean) / self.scale) @ self.shape + self.bias
        if len(self.words) and len(buckets):
            at = np.minimum(np.searchsorted(self.words, buckets), len(self.words) - 1)
            gain = np.where(self.words[at] == buckets, self.weights[at], 0.0)
            total = np.concatenate([[0], np.cumsum(gain)])
            out = out + total[first[1:]] - total[first[:-1]]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(shape: np.ndarray, buckets: np.ndarray, first: np.ndarray, y: np.ndarray, selected: int = SELECTED, steps: int = 400) -> Linear:
    """Select words by their association with ``y``, then fit by Newton-scaled gradient steps with an L2 penalty."""
    n, rate = len(y), float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    mean = shape.mean(0) if n else np.zeros(len(SHAPE))
    scale = np.maximum(shape.std(0), 1e-3) if n else np.ones(len(SHAPE))
    none = Linear(mean, scale, np.zeros(len(SHAPE)), np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
    if not n or y.min() == y.max():
        return none
    doc = np.repeat(np.arange(n), np.diff(first))
    words, inverse = np.unique(buckets, return_inverse=True)
    with_ = np.bincount(inverse, minlength=len(words))
    hits = np.bincount(inverse, weights=y[doc], minlength=len(words))
    # signed root of the G statistic of presence against the label
    p, e = hits / with_, with_ * rate
    part = lambda o, q: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(q, 1e-9)), 0.0)
    g = 2 * (part(hits, e) + part(with_ - hits, with_ - e))
    least = 2 * np.log(max(len(words), 2)) + 6
    pick = np.sort(np.argsort(-g)[:selected])
    pick = pick[(g[pick] > least) & (p[pick] > rate)]
    x = np.zeros((n, len(SHAPE) + len(pick)))
    x[:, : len(SHAPE)] = (shape - mean) / scale
    at = np.full(len(words), -1)
    at[pick] = np.arange(len(pick))
    own = at[inverse] >= 0
    x[doc[own], len(SHAPE) + at[inverse][own]] = 1
    w, b = np.zeros(x.shape[1]), none.bias
    penalty = 0.3
    curve = 0.25 * (x**2).sum(0) + penalty
    speed_w, speed_b = np.zeros_like(w), 0.0
    for _ in range(steps):
        r = sigmoid(x @ w + b) - y
        speed_w = 0.9 * speed_w - 0.3 * (x.T @ r + penalty * w) / curve
        speed_b = 0.9 * speed_b - 0.3 * r.sum() / (0.25 * n)
        w, b = w + speed_w, b + speed_b
    return Linear(mean, scale, w[: len(SHAPE)], words[pick], w[len(SHAPE) :], float(b))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> dict[str, Linear]:
    """Models of ``bad`` (quality 0) and ``toxic`` from at most ``rows`` labelled documents.

    The rows are those of the labels with the least hash of the id, so the choice does not depend on the
    order of the table; their features, not their texts, go to the driver.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(rows).collect()
    by_id = {r["_id"]: (1 - r["quality"], r["toxic"]) for r in picked}
    # found by a join with these few ids, so that no other text reaches Python; of rows that repeat an id the one of least text hash
    kind = docs.schema[doc_id].dataType
    wanted = docs.sparkSession.createDataFrame([(r["_id"],) for r in picked], T.StructType([T.StructField("_id", labels.schema[doc_id].dataType)]))
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(wanted), "_id", "left_semi")
    own = own.groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    schema = T.StructType([T.StructField("_id", kind), T.StructField("shape", T.ArrayType(T.DoubleType())), T.StructField("words", T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch) -> dict:
        shapes, words = [], []
        for s in slabs(batch.column(1)):
            shape, bucket, first = features(s)
            shapes += shape.tolist()
            words += [bucket[a:b].astype(np.int32) for a, b in zip(first[:-1], first[1:])]
        return {"_id": batch.column(0), "shape": shapes, "words": words}

    found = map_batches(own, run, schema).toArrow()
    table = found.sort_by("_id")
    ids = table.column("_id").to_pylist()
    words = table.column("words").combine_chunks()
    shape = table.column("shape").combine_chunks().flatten().to_numpy().reshape(len(ids), len(SHAPE))
    first = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())]).astype(np.int64)
    buckets = words.flatten().to_numpy().astype(np.int64)
    y = np.array([by_id[i] for i in ids], float).reshape(len(ids), 2)
    return {name: fit(shape, buckets, first, y[:, k]) for k, name in enumerate(LABELS)}


def score(docs: DataFrame, models: dict[str, Linear], *, text: str = "text") -> DataFrame:
    """Add ``logit_doc``: the document's own log-odds of being good, that is neither bad nor toxic."""
    bound_batches(docs.sparkSession)
    base = docs.drop("logit_doc")
    schema = T.StructType([*base.schema.fields, T.StructField("logit_doc", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for s in slabs(batch.column(text)):
            x = features(s)
            bad = [sigmoid(models[k].logits(*x)) for k in LABELS]
            good = np.clip((1 - bad[0]) * (1 - bad[1]), 1e-6, 1 - 1e-6)
            out.append(np.log(good / (1 - good)))
        return {n: batch.column(n) for n in batch.schema.names} | {"logit_doc": np.concatenate(out)}

    return map_batches(base, run, schema)


def shrunk(n: Column, total: Column, prior: Column, strength: Column) -> Column:
    return (strength * prior + total) / (strength + n)


def site_posteriors(scored: DataFrame, *, least_strength: float = 2.0, most_strength: float = 1e6) -> DataFrame:
    """``host``, ``path``, the shrunk rates and the counts, from grouped sums of the document probabilities.

    The grouped table has a row for each path; hosts and the global rate are sums over it.
    """
    good = 1 / (1 + F.exp(-F.col("logit_doc")))
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("s"))
    # a few numbers a site: an eighth of the tasks that sum them up can write them
    paths = materialise(paths.coalesce(max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    everything = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    rate = min(max((everything["s"] or 0.0) / (everything["n"] or 1), 1e-6), 1 - 1e-6)

    def strength(sites: DataFrame, n: str, s: str, prior: Column) -> float:
        # moments of rates around their priors: what binomial noise does not explain is the sites' spread
        x = sites.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col(n) * (F.col(s) / F.col(n) - prior) ** 2).alias("v"), F.sum(F.col(n) * prior * (1 - prior)).alias("b")).first()
        if not x["n"] or not x["b"]:
            return most_strength
        p = x["b"] / x["n"]
        spread = (x["v"] - x["k"] * p) / max(x["n"] - x["k"], 1)
        return float(np.clip(p / spread - 1 if spread > 0 else most_strength, least_strength, most_strength))

    by_host = strength(hosts, "host_n", "host_s", F.lit(rate))
    hosts = hosts.withColumn("host_rate", shrunk(F.col("host_n"), F.col("host_s"), F.lit(rate), F.lit(by_host)))
    # broadcast or not is left to the size of the hosts' table
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    by_path = strength(both, "n", "s", F.col("host_rate"))
    out = both.withColumn("path_rate", shrunk(F.col("n"), F.col("s"), F.col("host_rate"), F.lit(by_path)))
    # written, so that its size is known when it is joined: beyond the session's limit it is not broadcast
    rates = materialise(out.select("host", "path", F.col("n").alias("path_n"), "host_n", "host_rate", "path_rate", F.lit(rate).alias("global_rate")), "rates", paths.count())
    discard(paths)
    return rates


OWN = ("path_n", "host_rate", "path_rate", "site_shift", "p_good", "kept")


def classify(scored: DataFrame, sites: DataFrame, *, site_weight: float = 1.0, least: float = 0.5) -> DataFrame:
    """Add ``OWN`` (of them ``p_good`` and ``kept``): the documents' evidence and their sites' together.

    ``scored`` should be a written table where its texts are long: it is read here and for the sites.
    """
    logit = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    own = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "path_n", "host_rate", "path_rate", (logit("path_rate") - logit("global_rate")).alias("site_shift"))
    scored = scored.drop(*OWN)
    joined = scored.join(own, scored["host"].eqNullSafe(own["_h"]) & scored["path"].eqNullSafe(own["_p"]), "left").drop("_h", "_p")
    odds = F.col("logit_doc") + F.lit(site_weight) * F.coalesce("site_shift", F.lit(0.0))
    return joined.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("p_good") >= least)
