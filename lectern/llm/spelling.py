"""Spelling variants: a trie self-join of the vocabulary with active-node sets.

1. Words are counted over all documents; those that are long and frequent enough are the vocabulary, numbered in
   code-point order.
2. The vocabulary's trie is partitioned by prefix. Two words whose shorter one has n letters differ at a place between 0
   and n; a partition holds the words of n and n + 1 letters that share all letters before a range of places and all
   letters behind it, so it is the trie below one prefix for the words of one ending. Each word is in a partition for
   each range, and a pair of words is joined in that of its first differing place: once. Ranges are halves of the word,
   halved on up to ``SPAN`` places, and halved again while over ``MOST`` words share a partition, so that a prefix with a
   third of the vocabulary is dealt over its longer prefixes. A range of one place ends this: letters alone bound it.
3. In a partition the words' letters in the range make a trie. Each node has the set of active nodes, those whose
   prefixes are at most one insertion, deletion or replacement from its own; a child's set is made from its parent's.
   Words that end at a node are near those that end at its active nodes of distance one.
4. A partition gives counts and the best near word of each word, never the pairs; they are summed by word. Chains of
   forms are followed by pointer doubling over tables.

Partitions are known by 128 bits of BLAKE2b of their prefix and ending; within one, words are compared letter by letter.

Edge cases: null and empty texts have no words; a null id is written as the empty text; rows that repeat an id and a text
count again; a very long run of letters is a word like any other, and enters partitions by its ranges of ``SPAN`` letters;
near words of equal count are ordered by code points; an empty table or vocabulary gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.acquisition import number_rows
from .shared import discard, materialise, tasks_for
from .textkit import LOWER, NONSPACE, Slab, bound_batches, byte_class, find_words, map_batches, slabs

LEAST_LETTERS, LEAST_COUNT, RATIO, ONE_IN = 6, 5, 5, 199
#: Most places of a range at first, and most words of a partition whose range can be halved.
SPAN, MOST = 16, 1000
LETTERS = byte_class((65, 90), (97, 122))


def letter_runs(slab: Slab) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    r"""Of the runs of ``[A-Za-zÀ-ÿ]``, A-Z lower-cased: their texts, and their places among the distinct ones, and those."""
    inside = LETTERS[slab.buf] | (slab.buf == 0xC3)
    inside[1:] |= slab.buf[:-1] == 0xC3  # C3 and the byte behind it are U+00C0 to U+00FF
    runs = find_words(slab._replace(buf=np.where(inside, 0x61, 0x20).astype(np.uint8)), NONSPACE)
    bounds = np.concatenate([[0], np.cumsum(runs.end - runs.start)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(runs.start), [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[slab.buf[inside]])]).dictionary_encode()
    return runs.doc, coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def count_words(docs: DataFrame, *, least: int = LEAST_LETTERS, one_in: int | None = ONE_IN) -> DataFrame:
    """(``word``, ``n``) of all words of at least ``least`` letters.

    Of a document's runs, those whose CRC-32 of id and run ``one_in`` divides lose a letter, chosen by it; None leaves all as they are.
    """

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column(0).to_pylist()
        total: dict[bytes, int] = {}
        for slab in slabs(batch.column(1)):
            doc, distinct, code = letter_runs(slab)
            words = distinct.to_pylist()
            letters = pc.utf8_length(distinct.cast(pa.large_string())).to_numpy()
            fit = letters[code] >= least
            pair, count = np.unique(doc[fit] * max(len(words), 1) + code[fit], return_counts=True)
            owner, code = np.divmod(pair, max(len(words), 1))
            seeds = [crc32(f"{'' if i is None else i}:".encode()) for i in ids[slab.lo : slab.hi]]
            if one_in:
                sums = np.fromiter((crc32(words[w], seeds[d]) for d, w in zip(owner.tolist(), code.tolist())), np.int64, len(code))
                for k in np.flatnonzero(sums % one_in == 0).tolist():
                    word = words[code[k]].decode()
                    at = int(sums[k]) % len(word)
                    if len(word) > least:
                        short = (word[:at] + word[at + 1 :]).encode()
                        total[short] = total.get(short, 0) + int(count[k])
                    count[k] = 0
            sums = np.bincount(code, count, len(words)).astype(np.int64)
            for k in np.flatnonzero(sums).tolist():
                total[words[k]] = total.get(words[k], 0) + int(sums[k])
        return {"word": pa.array(list(total), pa.binary()).cast(pa.string()), "n": list(total.values())}

    counted = map_batches(docs.select(F.col("doc_id").cast("string"), "text"), run, T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


# --- partitions


def digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return h.digest()


def halve(key: bytes, letters: str, width: int, longer: bool) -> list[tuple[bytes, str, int, bool]]:
    """The two partitions of a word for the halves of a range of ``width`` places: what lies outside a half goes into its key."""
    mid = width // 2
    end = mid + longer
    return [(digest(key, b"<", letters[end:].encode()), letters[:end], mid, longer), (digest(key, b">", letters[:mid].encode()), letters[mid:], width - mid, longer)]


def ranges(word: str, least: int, span: int) -> list[tuple[bytes, str, int, bool]]:
    """The partitions of a word: as the shorter or equal one of a pair, and as the longer one."""
    out, n = [], len(word)
    for short in (n, n - 1):
        if short < least:
            continue
        todo = halve(short.to_bytes(8, "little"), word, short + 1, short < n)
        while todo:
            part = todo.pop()
            if part[2] > span:
                todo += halve(*part)
            else:
                out.append(part)
    return out


ENTRY = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("letters", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("longer", T.BooleanType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])


def entries(rows: DataFrame, parts) -> DataFrame:
    """A row for each partition that ``parts`` gives of a row's columns but the last two, ``id`` and ``n``."""

    def run(batch: pa.RecordBatch) -> dict:
        out = [(*p, i, n) for *own, i, n in zip(*(c.to_pylist() for c in batch.columns)) for p in parts(*own)]
        return dict(zip(ENTRY.fieldNames(), zip(*out))) if out else None

    return map_batches(rows, run, ENTRY)


def partition(vocabulary: DataFrame, least: int = LEAST_LETTERS, span: int = SPAN, most: int = MOST) -> DataFrame:
    """The words in their partitions, written; partitions of over ``most`` words are halved until none can be."""
    done = materialise(entries(vocabulary.select("word", "id", "n"), lambda w: ranges(w, least, span)), "partitions")
    while True:
        large = materialise(done.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("width").alias("width")).where(f"size > {most} and width > 1").select("key"), "large")
        if large.isEmpty():
            discard(large)
            return done
        split = entries(done.join(large, "key", "left_semi").select(*ENTRY.fieldNames()), halve)
        new = materialise(done.join(large, "key", "left_anti").select(*ENTRY.fieldNames()).unionAll(split), "partitions")
        discard(done, large)
        done = new


# --- the join within a partition


def trie(texts: list[str]) -> tuple[list[dict[str, int]], list[list[int]]]:
    """Children by letter of each node, and the texts that end there; node 0 is the root."""
    children, ends = [{}], [[]]
    for k, text in enumerate(texts):
        node = 0
        for c in text:
            child = children[node].get(c)
            if child is None:
                child = children[node][c] = len(children)
                children.append({})
                ends.append([])
            node = child
        ends[node].append(k)
    return children, ends


def near_texts(texts: list[str]):
    """(i, j) for all i and all j at distance one from it, by active nodes."""
    children, ends = trie(texts)
    todo = [(0, set(children[0].values()))]
    while todo:
        # besides a node itself, at distance zero, its active nodes at distance one
        node, active = todo.pop()
        if ends[node]:
            for u in active:
                for j in ends[u]:
                    for i in ends[node]:
                        yield i, j
        own = children[node]
        for c, child in own.items():
            # its letter deleted, another in its place, one inserted behind it, and the same letter after an earlier difference
            found = {node, *own.values(), *children[child].values()}
            for u in active:
                v = children[u].get(c)
                if v is not None:
                    found.add(v)
            found.discard(child)
            todo.append((child, found))


def first_difference(a: str, b: str) -> int:
    for k, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return k
    return min(len(a), len(b))


NEAR = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "n_near", "best_n", "best_id")])


def join_partition(letters: list[str], width: int, longer: list[bool], ids: list[int], counts: list[int], found: dict[int, list[int]]) -> None:
    """Adds to ``found``, by id, the number of near words that differ first in the range, and the best of them."""
    if all(longer):
        return
    for i, j in near_texts(letters):
        if (longer[i] and longer[j]) or first_difference(letters[i], letters[j]) >= width:
            continue
        best = found.setdefault(ids[i], [0, 0, 0])
        best[0] += 1
        if (-counts[j], ids[j]) < (-best[1], best[2]):
            best[1:] = counts[j], ids[j]


def join_partitions(placed: DataFrame) -> DataFrame:
    """Near words by partition of rows that are dealt and sorted by ``key``; a partition cut by a batch is carried over."""

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            rest = yield from flush(table, last=False)
        if rest is not None:
            yield from flush(rest, last=True)

    def flush(table: pa.Table, last: bool):
        keys = table.column("key").combine_chunks()
        starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1, [len(keys)]])
        sizes = np.diff(starts)
        if not last:
            sizes = sizes[:-1]
        many = np.flatnonzero(sizes > 1)
        rows = table.take(np.concatenate([np.arange(starts[k], starts[k + 1]) for k in many])) if len(many) else table.slice(0, 0)
        cols = [rows.column(c).to_pylist() for c in ("letters", "width", "longer", "id", "n")]
        found: dict[int, list[int]] = {}
        at = 0
        for size in sizes[many].tolist():
            letters, width, longer, ids, counts = (c[at : at + size] for c in cols)
            join_partition(letters, width[0], longer, ids, counts, found)
            at += size
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*found.values()))], names=NEAR.fieldNames())
        return None if last else table.slice(starts[-2])

    return placed.select(*ENTRY.fieldNames()).mapInArrow(run, NEAR)


# --- forms


def roots(forms: DataFrame) -> DataFrame:
    """(``id``, ``root_id``) by pointer doubling over (``id``, ``form_id``), which has no cycles."""
    at = materialise(forms.select("id", F.col("form_id").alias("root_id"), F.lit(True).alias("moved")), "roots")
    while not at.where("moved").isEmpty():
        onward = at.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        new = materialise(at.join(onward, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = new
    return at.select("id", "root_id")


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, count: int = LEAST_COUNT, ratio: int = RATIO, one_in: int | None = ONE_IN, span: int = SPAN, most: int = MOST) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of the vocabulary.

    A word's form is its most frequent near word, if that is ``ratio`` times as frequent; its root ends the chain of forms.
    """
    bound_batches(docs.sparkSession)
    counted = count_words(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), least=least, one_in=one_in).where(F.col("n") >= count)
    vocabulary = materialise(number_rows(counted, "word").select(F.col("rn").cast("long").alias("id"), "word", "n"), "vocabulary")
    placed = partition(vocabulary, least, span, most)
    tasks = tasks_for(placed.agg(F.coalesce(F.sum(F.octet_length("letters") + 64), F.lit(0))).first()[0])
    best = F.max(F.struct("best_n", (-F.col("best_id")).alias("best_id")))
    near = join_partitions(placed.repartition(tasks, "key").sortWithinPartitions("key")).groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    known = vocabulary.join(near, "id", "left").withColumn("has", F.col("best.best_n") >= ratio * F.col("n"))
    known = materialise(known.select("id", "word", "n", "n_near", F.expr("if(has, best.best_n, null)").alias("form_n"), F.expr("if(has, -best.best_id, null)").alias("form_id")), "near")
    discard(placed)
    ends = roots(known.where("form_id is not null").select("id", "form_id"))
    words = vocabulary.select("id", "word")
    form = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    root = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    full = known.join(ends, "id", "left").join(form, "form_id", "left").join(root, "root_id", "left")
    return full.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
