import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import lexical
from lectern.llm.queries import QUERIES
from tests.conftest import SMALL


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k=50):
    """Every document scored for every item."""
    tfs = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if df[t]}
        scored = []
        for i, c in tfs:
            if i is not None and c:
                m = 50 + 50 * sum(c.values()) * n_docs // n_terms
                score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weight.items() if c[t])
                if score > 0:
                    scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def run(spark, docs, items, **settings):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.rank_documents(d, i, **settings).collect()))


def test_small_cases(spark):
    docs = [(3, "the cat sat"), (1, "The CAT sat."), (2, None), (4, ""), (5, "..."), (None, "cat cat cat"), (7, "dog\x00cat é É"), (7, "dog dog"), (-9, "cat " * 40), (9, "sat on the mat " * 9), (2**62, "cat"), (-(2**62), "dog")]
    items = [(1, "CAT sat"), (2, None), (3, "no such"), (None, "cat"), (4, "dog"), (4, "mat é"), (5, "the the the")]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, items, k=2) == plain(docs, items, 2)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [], []) == []
    assert run(spark, [(1, None)], items) == []


def test_registered_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_ranked_search"](spark, SMALL).collect())) == plain(docs, items)


def test_many_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vocabulary = ["w%d" % k for k in range(60)]
    docs = [(int(k), " ".join(rng.choice(vocabulary, rng.integers(0, 30), p=np.arange(60, 0, -1) / 1830))) for k in rng.permutation(900)]
    items = [(k, " ".join(rng.choice(vocabulary, 5))) for k in range(30)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr("lectern.llm.textkit.BATCH_ROWS", 50)
    index = lexical.build_index(d, shard_bytes=2000)
    assert index.select("shard").distinct().count() > 5
    assert sorted(map(tuple, lexical.search(index, i, k=10, block=7).collect())) == plain(docs, items, 10)


def test_text_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "x", 5, 0)], "own long, body string, term string, df long, doc_id long")
    items = spark.createDataFrame([("b", "two", 1), ("a", "one", 2)], "item_id string, text string, shard int")
    found = lexical.rank_documents(docs, items, doc_id="own", text="body")
    assert sorted((r.item_id, r.rank, r.doc_id) for r in found.collect()) == [("a", 1, 1), ("b", 1, 1)]


def test_very_long_text(spark):
    rng = np.random.default_rng(7)
    long = " ".join("w%d" % k for k in rng.zipf(1.3, 800_000) % 100_000)
    docs, items = [(1, long), (2, "w1 w2 w3"), (3, "w77 other")], [(0, "w1 w77 w99999"), (1, long[:3000])]
    assert run(spark, docs, items) == plain(docs, items)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=40))
def test_packing(values):
    assert lexical.unpack(lexical.pack(np.array(values, np.uint64))[0].tobytes()).tolist() == values


@pytest.mark.parametrize("window", [1, 2, 7, 1024])
def test_merge_in_document_order(window):
    rng = np.random.default_rng(window)
    lists = [(np.sort(rng.choice(500, n, replace=False)), rng.integers(0, 50, n)) for n in (1, 3, 60, 200, 499)]
    ids = np.arange(480) * 3 - 700
    best = lexical.Best(25)
    lexical.merge(lists, ids, best, window)
    total = np.zeros(500, np.int64)
    for places, parts in lists:
        total[places] += parts
    want = sorted(((int(s), -int(i)) for s, i in zip(total, ids) if s > 0), reverse=True)[:25]
    assert sorted(best.heap, reverse=True) == want
