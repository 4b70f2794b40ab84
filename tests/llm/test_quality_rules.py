import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from lectern.llm import quality_rules as Q
from lectern.llm.textkit import slabs


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    count = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    marked = {j for i in range(n - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    best = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    long_ = [(i, b) for i, b in enumerate(best) if b >= 5]
    covered = {j for i, b in long_ for j in range(i, i + b)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked), len(covered), max((b for _, b in long_), default=0)


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_covered_words", "longest_repeat_words"]


@pytest.mark.parametrize("limit", [200, 1 << 20])
def test_measures_against_brute_force(limit):
    rng = random.Random(limit)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) + "\n" * rng.randint(0, 2) for _ in range(150)]
    texts += [None, "", " \n", "é|<b ñ\nx\nx\n \n \n", "a " * 200, "one two three four five six\n" * 3]
    got = []
    for s in slabs(pa.array(texts, pa.string()), limit):
        m = Q.measure(s, 5, 5)
        got += list(zip(*[m[k].tolist() for k in FIELDS]))
    assert got == [brute(t) for t in texts]


def test_verdicts_nulls_and_clashing_columns(spark):
    rng = random.Random(1)
    clean = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400))
    long_repeat = " ".join([clean, *clean.split()[:60], *clean.split()[:60]])
    rows = [(1, clean), (2, None), (3, "too short"), (4, "a b c d e " * 50), (1, clean), (5, long_repeat + " " + long_repeat)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS kept")
    got = sorted([(r.doc_id, r.base_failed, r.kept) for r in Q.quality_rules(df).collect()])
    assert got == [(1, False, True), (1, False, True), (2, True, False), (3, True, False), (4, True, False), (5, True, False)]
    assert Q.quality_rules(df.limit(0)).collect() == []


def test_longest_repeat_limit(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    part = [word() for _ in range(120)]
    text = " ".join([*part, *[word() for _ in range(2000)], *part])
    row = Q.quality_rules(spark.createDataFrame([(text,)], "text string")).first()
    assert not row.base_failed and row.longest_repeat_words == 120 and row.n_maximal_repeats == 2 and not row.kept


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomial_hashes_confuse(n):
    text = f"{thue_morse(n)} one two three four {thue_morse(n, True)} one two three four"
    m = Q.measure(next(slabs(pa.array([text]))), 5, 5)
    assert m["n_repeat_words"].tolist() == [0] == m["n_maximal_repeats"].tolist()


def test_very_long_text():
    rng = random.Random(5)
    part = " ".join(str(rng.random()) for _ in range(30))
    text = " ".join([part, *[str(rng.random()) for _ in range(500_000)], part])
    assert len(text) > 9_000_000
    m = Q.measure(next(slabs(pa.array([text], pa.large_string()))), 5, 5)
    assert m["n_words"][0] == 500_060 and m["n_repeat_words"][0] == 60 and m["longest_repeat_words"][0] == 30


def test_query_against_brute_force(spark):
    from lectern.llm.queries import QUERIES
    from tests.conftest import SMALL

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op3_quality_rules"](spark, SMALL).collect():
        want = brute(texts[r.doc_id])
        assert tuple(r[f] for f in FIELDS) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.repeat_covered_chars <= 0.2 * want[1] and want[6] <= 100)
