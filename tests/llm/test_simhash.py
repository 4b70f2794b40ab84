import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import simhash
from lectern.llm.queries import QUERIES
from tests.conftest import SMALL


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows: list[tuple]) -> dict:
    """Least id reachable by each fingerprint, comparing all pairs."""
    fps = sorted({fp for _, fp in rows})
    head = {fp: fp for fp in fps}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for k, x in enumerate(fps):
        for y in fps[k + 1 :]:
            if (x ^ y).bit_count() <= 2:
                head[top(x)] = top(y)
    least = {}
    for i, fp in rows:
        if i is not None:
            least[top(fp)] = min(least.get(top(fp), i), i)
    return {fp: least.get(top(fp)) for fp in fps}


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r[0], r[1] % (1 << 64), r[2]) for r in simhash.near_duplicates(docs).collect()), key=str)


def expected(rows):
    own = [(i, plain_fingerprint(t)) for i, t in rows]
    group = plain_components(own)
    return sorted(((i, fp, group[fp]) for i, fp in own), key=str)


def test_small_cases(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(5, None), (3, ""), (9, " \t\n"), (1, base), (2, base.upper()), (2, base), (7, base + " nu"), (None, base), (8, "One"), (6, "one two"), (4, "é É\x00x y\x0bz"), (None, "alone here now")]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((i, f"{fp:016x}", c) for i, fp, c in expected([tuple(r) for r in docs]))
    assert sorted(map(tuple, QUERIES["op12_simhash_near_dedup"](spark, SMALL).collect())) == want


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 3, "x", 0), (2, "a b c", 4, "y", 1)], "own long, body string, fp long, text string, doc_id long")
    found = simhash.near_duplicates(docs, doc_id="own", text="body")
    assert found.columns == ["doc_id", "fp", "component_id"]
    assert sorted((r[0], r[2]) for r in found.collect()) == [(1, 1), (2, 1)]


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "a b c"), ("a", "A b c"), (None, "A b c")], "doc_id string, text string")
    assert sorted((str(r[0]), r[2]) for r in simhash.near_duplicates(docs).collect()) == [("None", "a"), ("a", "a"), ("b", "a")]


def test_very_long_text(spark):
    rng = np.random.default_rng(5)
    words = ["w%d" % k for k in rng.integers(0, 5000, 400_000)]
    long = " ".join(words)
    rows = [(1, long), (2, long + "  END"), (3, "short one")]
    assert run(spark, rows) == expected(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aAbé \t\n", max_size=40), max_size=12))
def test_fingerprints(texts):
    import pyarrow as pa

    from lectern.llm.textkit import slabs

    found = [x for s in slabs(pa.array(texts, pa.large_string()), 30) for x in simhash.fold(*simhash.shingle_hashes(s, 3)).tolist()]
    assert found == [plain_fingerprint(t) for t in texts]


def test_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = np.random.default_rng(1)
    first = np.concatenate([[0], np.cumsum(rng.integers(0, 12, 30))])
    hashes = rng.integers(0, 2**64, int(first[-1]), dtype=np.uint64)
    for k, fp in enumerate(simhash.fold(hashes, first).tolist()):
        own = hashes[first[k] : first[k + 1]].tolist()
        assert fp == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_links_meet_at_an_anchor(threshold):
    """Every anchor is a code word, and any two words within the threshold share one."""
    rng = np.random.default_rng(threshold)
    masks = simhash.anchor_masks(1 + (threshold + 1) // 2)
    anchors = lambda x: set((x ^ masks[int(simhash.syndromes(np.array([x]))[0])]).tolist())
    for x in rng.integers(0, 2**64, 40, dtype=np.uint64):
        own = anchors(x)
        assert not simhash.syndromes(np.array(sorted(own), np.uint64)).any()
        for _ in range(20):
            y = x
            for b in rng.choice(64, threshold, replace=False):
                y = y ^ (np.uint64(1) << np.uint64(b))
            assert own & anchors(y)


def test_dense_cluster(spark):
    """All words within two bits of one, and chains; anchors hold 2,081 at most."""
    from pyspark.sql import functions as F

    centre = 0x0123456789ABCDEF
    near = [centre] + [centre ^ 1 << a for a in range(64)] + [centre ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)]
    fps = np.array(near, np.uint64).view(np.int64)
    placed = simhash.replicate(spark.createDataFrame([(int(x),) for x in fps], "fp long"), 2)
    assert placed.groupBy("anchor").count().agg(F.max("count")).first()[0] <= 2081
    ties = simhash.compare(placed.repartition(3, "anchor").sortWithinPartitions("anchor"), 2)
    assert simhash.components(ties, "fp", "head").select("comp").distinct().count() == 1


def test_forest_keeps_all_links():
    rng = np.random.default_rng(3)
    fp = (rng.integers(0, 1 << 8, 300) | 1 << 40).astype(np.int64)
    anchor = np.sort(rng.integers(0, 20, 300))
    order = np.lexsort((fp, anchor))
    a, b = simhash.forest(anchor[order], fp[order], 2)
    linked = plain_components([(int(x), int(x)) for x in fp])
    assert all(linked[int(x)] == linked[int(y)] for x, y in zip(a, b))
    one = np.zeros(len(set(fp.tolist())), np.int64)
    a, b = simhash.forest(one, np.array(sorted(set(fp.tolist()))), 2)
    heads = dict(zip(a.tolist(), b.tolist()))
    assert all(heads.get(int(x), int(x)) == linked[int(x)] for x in fp)
