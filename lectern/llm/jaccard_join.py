"""N-gram Jaccard join by MinHash banding.

1. Each text gets the set of its word n-gram hashes, a 128-bit fingerprint of the set, and MinHash band
   keys. Band and row counts are chosen for a target recall at the threshold (``choose_bands``).
2. Texts of one fingerprint are one *class* of copies; from here on a class is one row.
3. Band keys are shuffled. Classes that share a key are a *bucket*; buckets of equal members are one.
   A pair of classes is verified in one place, the bucket of the first band that both share.
4. The full n-gram sets of a bucket meet in one task, or, beyond ``CHUNK`` classes or ``CHUNK_BYTES``, in
   one task for each two chunks of it, and those pairs of a task that belong there are verified by exact
   intersection sizes. A task returns counts of links and ties within it, never the pairs. Connected
   components of the ties are the near-duplicate groups.

The result has a row for each document: its class of copies, its near-duplicate group, and the number
of links to different n-gram sets. Two texts with equal sets but different spelling are copies.

n-grams are known by sums of their words' hashes under random weights (64 bits in the sets, 128 in
fingerprints), and words by hashes that no form of a word defeats, so chance alone could make two equal.

Edge cases: a null or wordless text is in a group by itself with no links; a text of fewer than ``n``
words has one n-gram of them all; ids are of any type, null ids are allowed and rows of one id are told
apart by fingerprint; ties of least ids cannot occur, as a class has one; repeated rows each get their row; a
very long text's set is one row, held by a task once for each bucket; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shared import discard, materialise, size_shuffles, tasks_for
from .textkit import ALNUM, bound_batches, find_words, lists, map_batches, mix, shingle_hashes, slabs, word_digests, word_numbers

NGRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 100
#: Classes and bytes of sets of a bucket that meet in one task, and rows of a tile of the verification.
CHUNK, CHUNK_BYTES, TILE = 512, 4 << 20, 256
#: Buckets of at most so many classes are compared pair by pair.
FEW = 6
SLAB = 1 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: of those that reach ``recall`` at ``threshold`` with at most ``most`` hashes, the most rows."""
    for rows in range(most, 0, -1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall with so few hashes")


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20231107)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def text_sets(slab, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text of a slab, sorted, second hashes in that order, and the first of each text."""
    words = find_words(slab, ALNUM)
    numbers, distinct = word_numbers(slab, words, ALNUM)
    one, two, first = shingle_hashes(word_digests(distinct)[numbers], words.first, n)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(one)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(first) < 65536 else np.int64), kind="stable")]
    one, two, doc = one[order], two[order], doc[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (doc[1:] != doc[:-1])
    return one[new], two[new], np.searchsorted(doc[new], np.arange(len(first)))


def fingerprint(one: np.ndarray, two: np.ndarray) -> bytes | None:
    return hashlib.blake2b(one.tobytes() + two.tobytes(), digest_size=16).digest() if len(one) else None


def band_keys(sets: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band keys for each text that has n-grams."""
    some = first[:-1][first[:-1] < first[1:]]
    mul, add = seeds(bands * rows)
    out = np.zeros((len(some), bands), np.uint64)
    if not len(some):
        return out
    for k in range(bands):
        key = np.full(len(some), k + 1, np.uint64)
        for j in range(k * rows, (k + 1) * rows):
            x = sets * mul[j] + add[j]
            x ^= x >> np.uint64(32)
            key = mix(key ^ np.minimum.reduceat(x, some))
        out[:, k] = key
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``fp`` (null without words), ``size`` of the set, ``bytes`` of the text and ``bands`` of every document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("digest", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> dict:
        fps, keys, size, n_bytes = [], [], [], []
        for slab in slabs(batch.column(1), SLAB):
            one, two, first = text_sets(slab, n)
            fps += [fingerprint(one[a:b], two[a:b]) for a, b in zip(first[:-1], first[1:])]
            keys.append(band_keys(one, first, bands, rows).view(np.int64).ravel())
            size.append(np.diff(first))
            n_bytes.append(np.diff(slab.offs))
        size = np.concatenate(size)
        first = np.concatenate([[0], np.cumsum((size > 0) * bands)])
        return {"doc_id": batch.column(0), "digest": batch.column(2), "fp": fps, "size": size, "bytes": np.concatenate(n_bytes), "bands": lists(np.concatenate(keys), first, pa.int64())}

    return map_batches(docs.select("doc_id", "text", "digest"), run, schema)


class Tile:
    """Sets of up to ``TILE`` rows, as columns of their common vocabulary."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.vocabulary, self.column = np.unique(np.concatenate(sets), return_inverse=True)
        self.row = np.repeat(np.arange(len(sets)), self.size)

    def matrix(self, columns: np.ndarray) -> np.ndarray:
        """0/1 of the given columns, ascending, of the vocabulary."""
        at = np.full(len(self.vocabulary), -1)
        at[columns] = np.arange(len(columns))
        own = at[self.column] >= 0
        out = np.zeros((len(self.size), len(columns)), np.float32)
        out[self.row[own], at[self.column[own]]] = 1
        return out


def intersections(a: Tile, b: Tile, width: int = 4096) -> np.ndarray:
    """Exact intersection sizes of all rows of two tiles."""
    _, x, y = np.intersect1d(a.vocabulary, b.vocabulary, assume_unique=True, return_indices=True)
    out = np.zeros((len(a.size), len(b.size)), np.float32)
    for k in range(0, len(x), width):
        out += a.matrix(x[k : k + width]) @ b.matrix(y[k : k + width]).T
    return out


def meet_here(a: np.ndarray, b: np.ndarray, home: int) -> np.ndarray:
    """Which pairs of rows of two tables of buckets (a column for each band, 0 where alone) first meet in ``home``."""
    here, open_ = np.zeros((len(a), len(b)), bool), np.ones((len(a), len(b)), bool)
    for k in range(a.shape[1]):
        same = (a[:, k, None] == b[None, :, k]) & (a[:, k, None] != 0) & open_
        here |= same & (a[:, k, None] == home)
        open_ &= ~same
        if not open_.any():
            break
    return here


def link_group(sets: list[np.ndarray], buckets: np.ndarray, home: int, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of links between rows of ``left`` and of ``right`` (the same, or disjoint) that meet in ``home``, and the least tied row of each row."""
    n = len(sets)
    links, label = np.zeros(n, np.int64), np.arange(n)
    same = left is right
    pairs = []
    if n <= FEW:
        for k, x in enumerate(left):
            for y in right[k + 1 :] if same else right:
                shared = buckets[x][(buckets[x] == buckets[y]) & (buckets[x] != 0)]
                if len(shared) and shared[0] == home:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both >= threshold * (len(sets[x]) + len(sets[y]) - both) - 1e-6:
                        links[[x, y]] += 1
                        pairs.append((np.array([x]), np.array([y])))
    else:
        # rows of equal first buckets lie together, so that whole tiles have met elsewhere
        cut = lambda rows: [rows[k : k + TILE] for k in range(0, len(rows), TILE)]
        alike = lambda rows: rows[np.lexsort(buckets[rows].T[::-1])]
        lefts = [(r, Tile([sets[i] for i in r])) for r in cut(alike(left))]
        rights = lefts if same else [(r, Tile([sets[i] for i in r])) for r in cut(alike(right))]
        for i, (r, a) in enumerate(lefts):
            for q, b in rights[i if same else 0 :]:
                linked = meet_here(buckets[r], buckets[q], home)
                if a is b:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                both = intersections(a, b)
                linked &= both >= threshold * (a.size[:, None] + b.size[None, :] - both) - 1e-6
                links[r] += linked.sum(1)
                if a is not b:
                    links[q] += linked.sum(0)
                x, y = np.nonzero(linked)
                pairs.append((r[x], q[y]))
    x, y = (np.concatenate(p) for p in zip(*pairs)) if pairs else (np.zeros(0, int),) * 2
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return links, label
        label = new


VERIFIED = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("head", T.BinaryType())])


def verify_task(table: pa.Table, threshold: float) -> pa.Table:
    """Links and ties of the buckets, or chunks of buckets, of a task."""
    rows = {k: table.column(k).to_pylist() for k in ("home", "i", "j", "chunk", "node")}
    grams, buckets = table.column("grams").to_pylist(), table.column("buckets").to_pylist()
    parts: dict[tuple, dict[bytes, int]] = {}
    for k, key in enumerate(zip(rows["home"], rows["i"], rows["j"])):
        parts.setdefault(key, {}).setdefault(rows["node"][k], k)
    out = {"node": [], "n": [], "head": []}
    for (home, i, j), members in parts.items():
        nodes = sorted(members)
        at = [members[x] for x in nodes]
        sets = [np.frombuffer(grams[k], np.uint64) for k in at]
        chunk = np.array([rows["chunk"][k] for k in at])
        left = np.arange(len(at)) if i == j else np.flatnonzero(chunk == i)
        right = left if i == j else np.flatnonzero(chunk == j)
        links, label = link_group(sets, np.array([buckets[k] for k in at]), home, left, right, threshold)
        for k in np.flatnonzero(links):
            out["node"].append(nodes[k])
            out["n"].append(int(links[k]))
            out["head"].append(nodes[label[k]])
    return pa.table({f.name: pa.array(out[f.name], k) for f, k in zip(VERIFIED, (pa.binary(), pa.int64(), pa.binary()))})


def jaccard_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id``, ``copy_id`` (least id of its copies), ``class_id`` (least id of its near-duplicate group), ``n_copies``, ``n_links``.

    Where ids repeat, ``digest`` (of the text) tells the row and ``group`` the near-duplicate group (null without words).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    sig = materialise(signatures(docs, n, bands, rows), "signatures")
    n_docs, n_bytes = sig.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    size_shuffles(spark, n_bytes)
    # a class is found again by the row of least id (rows without one last) and the digest of its text
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    classes = sig.where("fp is not null").groupBy("fp").agg(pick.alias("pick"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = materialise(classes.select("fp", F.col("pick.doc_id").alias("rep"), F.col("pick.digest").alias("digest"), "n_copies", "size", "bands"), "classes", n_docs)
    # buckets, known by their members, so that bands with the same members are one
    keys = classes.select("fp", "size", F.posexplode("bands").alias("band", "key"))
    member = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "fp"))
    found = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"), F.xxhash64(F.count(F.lit(1)), member(1), member(2)).alias("home")).where("n > 1")
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("grams") * 8 / CHUNK_BYTES))
    found = found.select("key", "home", F.least(chunks, F.col("n")).cast("int").alias("chunks"))
    # of each class, its bucket by band (0 where alone), and the tasks to which its set goes
    place = F.struct("band", "home", "chunks")
    own = keys.join(found, "key").groupBy("fp").agg(F.collect_list(place).alias("at"))
    by_band = F.map_from_entries(F.transform("at", lambda x: F.struct(x["band"], x["home"])))
    own = own.select("fp", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.coalesce(F.try_element_at(by_band, k), F.lit(0).cast("long"))).alias("buckets"), F.array_distinct(F.transform("at", lambda x: F.struct(x["home"], x["chunks"]))).alias("at"))
    members = materialise(own.join(classes.select("fp", "rep", "digest", "size"), "fp").select(F.col("fp").alias("node"), "rep", "digest", "size", "buckets", "at"), "members", n_docs)
    total = members.select(F.sum(F.col("size") * 8 * F.aggregate("at", F.lit(0), lambda a, x: a + x["chunks"]))).first()[0] or 0
    tasks = tasks_for(total)
    # shuffled at every size, as what is joined grows with the documents; hashed, so that no texts are sorted
    wanted = members.select(F.col("rep").alias("_id"), F.col("digest").alias("_digest"), "node", "buckets", "at").hint("shuffle_hash")
    with_text = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]) & (docs["digest"] == wanted["_digest"])).select("text", "node", "buckets", "at")
    schema = T.StructType([*[with_text.schema[c] for c in ("node", "buckets", "at")], T.StructField("grams", T.BinaryType())])

    def sets_of(batch: pa.RecordBatch) -> dict:
        grams = []
        for slab in slabs(batch.column("text"), SLAB):
            one, _, first = text_sets(slab, n)
            grams += [one[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        return {c: batch.column(c) for c in ("node", "buckets", "at")} | {"grams": pa.array(grams, pa.binary())}

    # one task for each two chunks of a bucket; small buckets share tasks
    sets = map_batches(with_text, sets_of, schema).select("node", "buckets", "grams", F.explode("at").alias("to")).select("node", "buckets", "grams", "to.home", "to.chunks")
    sets = sets.withColumn("chunk", F.expr("pmod(xxhash64(node, home), chunks)").cast("int"))
    sets = sets.withColumn("ij", F.explode(F.expr("transform(sequence(0, chunks - 1), x -> struct(least(x, chunk) as i, greatest(x, chunk) as j))")))
    sets = sets.select("node", "buckets", "grams", "home", "chunk", "ij.i", "ij.j", F.when(F.col("chunks") > 1, F.xxhash64("home", "ij.i", "ij.j")).otherwise(F.expr(f"pmod(home, {tasks})")).alias("task"))
    verified = materialise(sets.repartition(tasks, "task").groupBy("task").applyInArrow(lambda t: verify_task(t, threshold), VERIFIED), "verified", n_docs)
    ties = verified.groupBy("node").agg(F.sum("n").alias("n_links"))
    groups = components(verified.where("node <> head"), "node", "head")
    full = classes.select("fp", "rep", "n_copies").join(ties.withColumnRenamed("node", "fp"), "fp", "left").join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    full = materialise(full.select("fp", "rep", "n_copies", F.coalesce("comp", "fp").alias("head"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "linked", n_docs)
    discard(classes, members, verified, groups)
    least = full.groupBy("head").agg(F.min("rep").alias("class_id"))
    known = full.join(least, "head").select("fp", F.col("head").alias("group"), F.col("rep").alias("copy_id"), "class_id", "n_copies", "n_links")
    return sig.select("doc_id", "digest", "fp").join(known, "fp", "left").select(
        "doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "digest", "group"
    )


def one_of_each(docs: DataFrame, joined: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: of least id, and of the group's rows with this id the one whose text has the least 64-bit hash.

    A text without words is a group by itself. Of rows that repeat an id and a text one stays. Rows without an
    id cannot be told apart by ``joined`` and stay.
    """
    from pyspark.sql import Window

    wordless = F.when(F.col("group").isNull(), F.col("digest"))
    chosen = joined.where("doc_id = class_id").groupBy(F.col("doc_id").alias("_id"), "group", wordless.alias("_wordless")).agg(F.min("digest").alias("_digest")).select("_id", "_digest").distinct()
    digested = docs.withColumn("_own", F.xxhash64(text))
    kept = digested.join(chosen.hint("merge"), (digested[doc_id] == chosen["_id"]) & (digested["_own"] == chosen["_digest"])).drop("_id", "_digest")
    own = Window.partitionBy(doc_id, "_own").orderBy("_own")
    kept = kept.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n", "_own")
    return kept.unionAll(docs.where(F.col(doc_id).isNull()).select(kept.columns))
