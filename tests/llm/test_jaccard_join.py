import random
import re

import numpy as np
import pytest

from lectern.llm import jaccard_join as J

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = sorted({g for _, t in rows if (g := grams(t))}, key=sorted)
    ids = {g: sorted((i for i, t in rows if grams(t) == g and i is not None)) for g in sets}
    links = {g: [h for h in sets if h != g and len(g & h) >= 0.8 * len(g | h) - 1e-9] for g in sets}
    group, seen = {}, set()
    for g in sets:
        if g in seen:
            continue
        todo, part = [g], {g}
        while todo:
            for h in links[todo.pop()]:
                if h not in part:
                    part.add(h)
                    todo.append(h)
        seen |= part
        least = min((i for h in part for i in ids[h]), default=None)
        group |= dict.fromkeys(part, least)
    out = []
    for i, t in rows:
        g = grams(t)
        out.append((i, ids[g][0] if g and ids[g] else i, group[g] if g else i, len(links[g]) if g else 0))
    return sorted(out, key=repr)


def corpus(seed, families=12, near=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(40, 150))]
        for _ in range(rng.randint(1, near)):
            own = base.copy()
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), (" " if rng.random() < 0.5 else "\n").join(own)))
        rows.append((len(rows), rows[-1][1]))
    rows += [(5000, None), (5001, ""), (5002, "a b"), (5003, "A, b!"), (5004, "..."), (3, rows[3][1]), (None, "one two three four five six")]
    return rows


@pytest.mark.parametrize("chunk", [J.CHUNK, 3])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(J, "CHUNK", chunk)
    monkeypatch.setattr(J, "TILE", 2 if chunk == 3 else 256)
    monkeypatch.setattr(J, "FEW", 0 if chunk == 3 else 6)
    rows = corpus(chunk)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS task")
    got = sorted([(r.doc_id, r.copy_id, r.class_id, r.n_links) for r in J.jaccard_join(df).collect()], key=repr)
    assert got == brute(rows)


def test_one_of_each(spark):
    rows = corpus(4)
    rows += [(None, rows[0][1]), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = J.one_of_each(df, J.jaccard_join(df)).collect()
    want = {c for i, _, c, _ in brute(rows) if i is not None and c == i}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in kept) == 2  # rows without an id stay


def test_one_of_each_where_ids_repeat(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    near = lambda k: text(k) + " more"
    # 1: two texts of two groups, and one near nothing; 4: its first text is a near copy of 3, its second is not
    rows = [(1, text("a")), (1, text("b")), (1, text("c")), (1, text("c")), (2, near("a")), (5, near("b")), (3, text("d")), (4, near("d")), (4, text("e")), (6, "!"), (6, "?"), (6, "?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in J.one_of_each(df, J.jaccard_join(df)).collect())
    assert kept == sorted([(1, text("a")), (1, text("b")), (1, text("c")), (3, text("d")), (4, text("e")), (6, "!"), (6, "?")])


def test_bands_reach_their_recall():
    for t in (0.7, 0.8, 0.9):
        b, r = J.choose_bands(t)
        assert 1 - (1 - t**r) ** b >= 0.999 and b * r <= J.MOST_HASHES


def test_tiles_count_exactly():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(20)]
    a, b = J.Tile(sets[:12]), J.Tile(sets[12:])
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in sets[12:]] for x in sets[:12]]
    assert (J.intersections(a, b, width=7) == want).all()


def test_empty_table(spark):
    assert J.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomial_hashes_confuse(spark, n):
    rows = [(k, " ".join([thue_morse(n, bool(k)), *"one two three four".split()])) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    joined = J.jaccard_join(df)
    assert {(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in joined.collect()} == {(0, 0, 1, 0), (1, 1, 1, 0)}
    assert J.one_of_each(df, joined).count() == 2


def test_each_pair_meets_once():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**60, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(80) < 0.95], rng.integers(0, 2**60, 3).astype(np.uint64)])) for _ in range(40)]
    buckets = rng.integers(0, 3, (40, 6))
    every = np.arange(40)
    total = np.zeros(40, int)
    for home in (1, 2):
        for few in (0, 100):
            J.FEW, old = few, J.FEW
            links, _ = J.link_group(sets, buckets, home, every, every, 0.8)
            J.FEW = old
            total += links
    want = [sum(2 * (i != j and bool(((buckets[i] == buckets[j]) & (buckets[i] > 0)).any()) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))) for j in range(40)) for i in range(40)]
    assert total.tolist() == want and sum(want) > 0


def test_null_and_text_ids_and_a_very_long_text(spark):
    rng = random.Random(9)
    words = [str(rng.random())[2:] for _ in range(300_000)]
    long_, other = " ".join(words), " ".join(words[:-10])
    rows = [("x", long_), ("y", other), (None, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l")]
    got = {(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(long_) > 5_000_000 and got == {("x", "x", 1, 1), ("y", "x", 1, 1), (None, None, 2, 0), (None, None, 1, 0)}


def test_many_repeated_rows(spark):
    df = spark.range(2000).selectExpr("7L AS doc_id", "'one two three four five six seven' AS text")
    joined = J.jaccard_join(df)
    assert {(r.class_id, r.n_copies, r.n_links) for r in joined.collect()} == {(7, 2000, 0)}
    assert J.one_of_each(df, joined).count() == 1
