import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import suffix_dedup as S


def brute(texts, least):
    count = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for t in data:
        for i in range(len(t) - least + 1):
            count[t[i : i + least]] += 1
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append(bytes(b for b, x in zip(t, gone) if not x))
    return out


@pytest.mark.parametrize("seed,least,gram,window,run_bytes,wide,run_wide", [(0, 20, 4, 12, 1500, 2048, 99), (1, 30, 5, 20, 1500, 2048, 3), (2, 24, 8, 16, 1 << 20, 2048, 1), (3, 20, 3, 18, 400, 2, 99), (4, 25, 6, 14, 900, 5, 2), (5, 22, 5, 15, 3000, 2048, 5)])
def test_against_brute_force(spark, seed, least, gram, window, run_bytes, wide, run_wide):
    rng = random.Random(seed)
    words = ["ab", "cde", "é", "x", "hello", "wörld", " ", "\n", "zzz", "\0"]
    text = lambda n: "".join(rng.choice(words) for _ in range(n))
    shared = [text(rng.randint(10, 60)) for _ in range(6)]
    texts = ["".join(rng.choice([text(rng.randint(1, 30)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 9) :]]) for _ in range(rng.randint(0, 6))) for _ in range(100)]
    texts += [texts[0], texts[1], "a" * 300, "a" * 250, "ab" * 100, "ab" * 100 + "c", "", None]
    texts += [shared[0] + text(8) for _ in range(40)]  # a class of many members
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS low", "3 AS mark").repartition(5)
    got = S.repeated_spans(df, least=least, gram=gram, window=window, run_bytes=run_bytes, wide=wide, run_wide=run_wide).collect()
    want = Counter((i, t or "", k) for (i, t), k in zip(rows, brute(texts, least)))
    assert Counter((r.doc_id, r.text, bytes(r.kept)) for r in got) == want
    for r in got:
        assert all(a < b for a, b in r.removed) and all(x[1] < y[0] for x, y in zip(r.removed, r.removed[1:]))


def test_loser_tree_merges_and_keeps_prefixes():
    rng = random.Random(0)
    for runs in (1, 2, 3, 7):
        width, made = 6, []
        for _ in range(runs):
            keys = sorted(bytes(rng.choice(b"ab") for _ in range(width)) for _ in range(rng.randint(1, 40)))
            common = [0] + [next((k for k in range(width) if a[k] != b[k]), width) for a, b in zip(keys, keys[1:])]
            made.append((keys, (common, b"".join(k[c:] for k, c in zip(keys, common)))))
        came, common = S.merge([m for _, m in made], width)
        at, out = [0] * runs, []
        for r in came:
            out.append(made[r][0][at[r]])
            at[r] += 1
        assert out == sorted(k for keys, _ in made for k in keys)
        assert common[1:] == [next((k for k in range(width) if a[k] != b[k]), width) for a, b in zip(out, out[1:])]


def test_every_window_has_an_anchor():
    s = S.Shape(20, 4, 12)
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 99, 500).astype(np.uint8)
    slab = S.Slab(0, 2, buf, np.array([0, 300, 500]))
    at, _ = S.anchors(slab, S.prefix_hash(buf), s)
    for a, b in ((0, 300), (300, 500)):
        for i in range(a, b - s.least + 1):  # texts shorter than that have none
            assert ((at >= i) & (at <= i + s.before)).any()


def test_empty_table(spark):
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hashes_tell_apart_what_polynomials_confuse():
    morse = lambda n, swap=0: bytes(97 + (bin(i).count("1") + swap) % 2 for i in range(n))
    data = morse(256) + morse(256, 1) + morse(256) + b"a" * 256
    low = [0, 256, 512, 768]
    one, two = S.digests(data, low, [x + 256 for x in low])
    assert one[0] == one[2] and two[0] == two[2] and len({*one.tolist()}) == len({*two.tolist()}) == 3


@pytest.mark.parametrize("ids", ["1L", "CAST(NULL AS LONG)", "id"])
def test_many_equal_rows(spark, ids):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij ") for _ in range(2400))
    df = spark.range(10_000).selectExpr(f"{ids} AS doc_id", f"'{text}' AS text")
    got = S.repeated_spans(df).selectExpr("size(removed) AS n", "length(kept) AS k", "removed[0] AS span").groupBy("n", "k", "span").count().collect()
    assert [(r.n, r.k, r.span, r["count"]) for r in got] == [(1, 0, [0, 2400], 10_000)]


def test_ids_of_other_types(spark):
    rng = random.Random(9)
    shared, own = ("".join(rng.choice("abcdefghij ") for _ in range(400)) for _ in range(2))
    rows = [("a", shared + own), ("b", "x" + shared), ("c", own[:100]), (None, shared)]
    got = {r.doc_id: r.removed for r in S.repeated_spans(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": [[0, 400]], "b": [[1, 401]], "c": [], None: [[0, 400]]}


def test_a_common_beginning_is_no_hot_key(spark):
    rng = random.Random(10)
    texts = ["x" * 16 + "".join(rng.choice("abcdefghij ") for _ in range(230)) for _ in range(3000)]
    got = S.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got.where("size(removed) > 0").count() == 0


def test_very_long_text(spark):
    rng = np.random.default_rng(11)
    long_ = rng.integers(97, 123, 10_000_000).astype(np.uint8).tobytes().decode()
    rows = [(1, long_), (2, long_[5_000_000:5_000_300]), (3, long_[:250])]
    got = {r.doc_id: r.removed for r in S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [[0, 250], [5_000_000, 5_000_300]], 2: [[0, 300]], 3: [[0, 250]]}


def test_query_against_brute_force(spark):
    import hashlib

    from lectern.llm.queries import QUERIES
    from tests.conftest import SMALL

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {r.doc_id: (len((r.text or "").encode()), len(k), hashlib.sha256(k).hexdigest()) for r, k in zip(rows, brute([r.text for r in rows], 200))}
    got = QUERIES["op9_suffix_dedup"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_bytes - r.n_removed, r.kept_sha256) for r in got} == want and any(r.n_spans for r in got)


@pytest.mark.parametrize("size", [64, 200, 1000])
def test_sections_have_the_anchors_of_the_whole(size):
    s = S.Shape(20, 4, 12)
    rng = np.random.default_rng(size)
    for buf in (rng.integers(97, 100, 3000).astype(np.uint8), np.tile(np.frombuffer(b"ab", np.uint8), 1500), np.full(3000, 97, np.uint8)):
        slab = S.Slab(0, 1, buf, np.array([0, len(buf)]))
        want = S.anchors(slab, S.prefix_hash(buf), s)[0].tolist()
        got = [a + p for part, a, x, y in S.sections(slab, s, size) for p in S.anchors(part, S.prefix_hash(part.buf), s)[0].tolist() if x <= p < y]
        assert got == want


def test_spans_unite():
    rng = np.random.default_rng(0)
    ids, mark, low = rng.integers(0, 4, 200), rng.integers(0, 2, 200), rng.integers(0, 2000, 200)
    high = low + rng.integers(1, 60, 200)
    bytes_of = lambda rows: {(i, m, p) for i, m, a, b in zip(*rows) for p in range(a, b)}
    got = S.united(ids, mark, low, high)
    assert bytes_of(got) == bytes_of((ids, mark, low, high))
    rows = sorted(zip(*[x.tolist() for x in got]))
    assert all(a[:2] != b[:2] or a[3] < b[2] for a, b in zip(rows, rows[1:]))
    assert [len(x) for x in S.united(*[np.zeros(0, np.int64)] * 4)] == [0] * 4


def test_text_that_repeats_itself(spark):
    """Against brute force at 20 KB, and whole at 4 MB each."""
    small = ["a" * 20_000, "ab" * 3_000 + "c" + "ab" * 3_000, ("-" * 300 + "\n") * 20, "x" + "a" * 205, "ab" * 101 + "z", "b" * 199, "abc" * 67 + "q"]
    rows = list(enumerate(small))
    got = {r.doc_id: bytes(r.kept) for r in S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute(small, 200)))
    large = [(1, "a" * 4_000_000), (2, "ab" * 2_000_000), (3, "x" + "ab" * 101 + "y")]
    got = {r.doc_id: r.removed for r in S.repeated_spans(spark.createDataFrame(large, "doc_id long, text string")).collect()}
    assert got == {1: [[0, 4_000_000]], 2: [[0, 4_000_000]], 3: [[1, 203]]}


def test_memory_of_text_that_repeats_itself():
    """10 MB of one letter, or of two, through the making of runs in under 500 MB."""
    import os
    import subprocess
    import sys

    script = """
import resource, sys
import numpy as np, pyarrow as pa
from lectern.llm import suffix_dedup as S
from lectern.llm.textkit import slabs
s, n = S.Shape(200, 16, 128), 0
for text in ("a" * 10_000_000, "ab" * 5_000_000):
    for slab in slabs(pa.array([text], pa.large_string())):
        for made in S.suffixes(slab, np.array([1]), np.array([2]), s):
            n += len(made[0])
            S.make_run([made], 8, s)
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=home, timeout=600)
    n, peak = map(int, done.stdout.split())
    assert n > 10_000_000 and peak < 500, (n, peak)
