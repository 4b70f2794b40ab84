import random
import re

import pytest

from lectern.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    patterns = {}
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if own := patterns.get(tuple(w[k : k + m])):
                    found |= own
                    hit.update(range(k, k + m))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,item_bytes", [(10, 1 << 20), (3, 1 << 20), (4, 200)])
def test_against_brute_force(spark, window, item_bytes):
    rng = random.Random(window)
    vocabulary = ["a", "B", "cé", "the", "x1", "日本", "of"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(0, 14))) for k in range(25)] + [(3, None), (99, "!!"), (98, "solo")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(150)] + [(None, "The of"), (7, None), (8, ""), (8, ""), (9, "solo " * 3)]
    docs += [(1000 + k, f"zz {t} zz") for k, t in items if t]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS hit_spans", "1 AS other")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(d, b, window=window, item_bytes=item_bytes).collect()
    rows = sorted([(r.doc_id, r.n_words, sum(y - x for x, y in r.hit_spans), list(r.hit_items)) for r in got], key=repr)
    assert rows == brute(docs, items, window)
    assert all(r.other == 1 for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(none, items).collect() == []
    assert D.decontaminate(one, items).first().hit_items == []


@pytest.mark.parametrize("item_bytes", [1 << 20, 1])
def test_items_without_an_id(spark, item_bytes):
    items = spark.createDataFrame([(None, "a b c"), (None, "d e f"), (7, "d e f"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "a b c d e f"), (3, "x y")], "doc_id long, text string")
    got = {r.doc_id: (r.hit_spans, r.hit_items) for r in D.decontaminate(docs, items, item_bytes=item_bytes).collect()}
    assert got == {1: ([[1, 4]], [None]), 2: ([[0, 6]], [7, None]), 3: ([], [])}


def test_ids_of_other_types_and_a_very_long_text(spark):
    rng = random.Random(4)
    long_ = " ".join(str(rng.random()) for _ in range(560_000))
    items = spark.createDataFrame([("b", "one two three"), ("a", " ".join(words(long_)[500:520]))], "item_id string, text string")
    docs = spark.createDataFrame([(1, "one two three"), (2, long_ + " one two three")], "doc_id long, text string")
    got = {r.doc_id: (len(r.hit_spans), r.hit_items) for r in D.decontaminate(docs, items).collect()}
    assert len(long_) > 10_000_000 and got == {1: (1, ["b"]), 2: (2, ["a", "b"])}


def test_one_window_in_many_items_and_places():
    import pyarrow as pa

    from lectern.llm.textkit import slabs

    own = D.Items(["a " * 3000] * 50, 10)
    counts, spans, items = own.scan(next(slabs(pa.array(["a " * 5000, "b a"]))))
    assert counts.tolist() == [5000, 2] and spans == [[[0, 5000]], []] and items == [list(range(50)), []]
