import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import spelling
from lectern.llm.queries import QUERIES
from tests.conftest import SMALL


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain(rows, least=6, count=5, ratio=5, one_in=199):
    """All words compared with all."""
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = crc32(f"{'' if i is None else i}:{word}".encode())
            if one_in and h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    n = {w: k for w, k in total.items() if len(w) >= least and k >= count}
    found = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= ratio * n[w] else None for w, v in found.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, spelling.variants(docs, **settings).collect()))


def test_small_cases(spark):
    words = {"colour": 30, "color": 99, "colours": 6, "colourss": 5, "ÉCLAIR×": 7, "Éclair×": 40, "eclair": 4, "éclair÷": 5, "abcdef": 5, "abcdeg": 5, "bbcdef": 25, "rare": 9, "aaaaaa": 5, "aaaaaaa": 27}
    rows = [(1, " ".join(w for w, k in words.items() for _ in range(k))), (2, None), (3, ""), (4, "1 2 3"), (None, "COLOUR colour"), (4, "colour"), (4, "colour")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, one_in=None) == plain(rows, one_in=None)
    assert run(spark, []) == []
    assert run(spark, [(1, "few words here")]) == []


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, QUERIES["op13_spelling_variants"](spark, SMALL).collect())) == plain([tuple(r) for r in docs])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "letters " * 5, "x", 1, 2)], "own long, body string, word string, n long, doc_id long")
    assert spelling.variants(docs, doc_id="own", text="body", one_in=None).collect()[0][:4] == ("letters", None, "letters", 5)


def test_hot_prefix(spark):
    """Most words share their first half, or their last; partitions are halved until they are small."""
    rng = np.random.default_rng(2)
    tail = lambda n: "".join(rng.choice(list("abc"), n))
    words = {"prefix" + tail(6) for _ in range(250)} | {tail(6) + "suffix" for _ in range(250)} | {tail(3) + "middle" + tail(3) for _ in range(100)}
    rows = [(k, " ".join(sorted(words) * 5)) for k in range(2)]
    assert run(spark, rows, most=5, one_in=None) == plain(rows, one_in=None)


def test_very_long_runs(spark):
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcdefgh"), 300_000))
    other = long[:123_456] + "z" + long[123_457:]
    shorter = long[:-1]
    rows = [(1, " ".join([long] * 30 + [other] * 5 + [shorter] * 6)), (2, "word " * 300_000)]
    found = {w: (f, r, n, k, m) for w, f, r, n, k, m in run(spark, rows, one_in=None)}
    assert found == {long: (None, long, 30, 2, None), other: (long, long, 5, 1, 30), shorter: (long, long, 6, 1, 30)}


def test_chains(spark):
    """A chain of forms of five links ends at its root."""
    words = ["abcdefgh"]
    for k in range(5):
        words.append(words[-1][:k] + "z" + words[-1][k + 1 :])
    rows = [(1, " ".join(w for k, w in enumerate(reversed(words)) for _ in range(5 ** (k + 1)))) ]
    got = run(spark, rows, one_in=None)
    assert got == plain(rows, one_in=None) and {r[2] for r in got} == {words[0]}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("ab", max_size=7), max_size=30))
def test_active_nodes(texts):
    texts = sorted(texts)
    got = list(spelling.near_texts(texts))
    assert sorted(got) == [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if near(a, b)]


@pytest.mark.parametrize("span", [1, 2, 5, 16])
def test_each_pair_meets_once(span):
    rng = np.random.default_rng(span)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(6, 10))) for _ in range(150)})
    groups: dict[bytes, list] = {}
    for k, w in enumerate(words):
        for key, letters, width, longer in spelling.ranges(w, 6, span):
            groups.setdefault(key, []).append((letters, width, longer, k))
    found: dict[int, list[int]] = {}
    for rows in groups.values():
        letters, width, longer, ids = zip(*rows)
        spelling.join_partition(list(letters), width[0], list(longer), list(ids), [1] * len(ids), found)
    assert {k: v[0] for k, v in found.items()} == {k: n for k, w in enumerate(words) if (n := sum(near(w, v) for v in words))}
