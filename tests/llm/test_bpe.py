import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe as B
from lectern.llm.textkit import slabs

PATH = P.path("byte_bpe_50k.tiktoken")
BPE = B.Bpe.of(PATH, P.PATTERN)
OTHER = B.Bpe(BPE.ranks, r"\p{L}+|\P{L}")
REF = tiktoken.Encoding("ref", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
PARTS = ["a", "  ", "\n", " the", "'s", "'ll", "'r", "'re", "1", "é", "!!", "😀", "\t", "x" * 30, "'", " " * 9, " ", "日本", " '", "''", "٣", " "]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@given(TEXTS, st.sampled_from([5, 8, 20, 33, 1000]), st.sampled_from([1, 2, 4]))
@settings(max_examples=400, deadline=None)
def test_chunks_stitch_to_the_whole(text, chunk, overlap):
    if text:
        for bpe in (BPE, OTHER):
            got = bpe.pretokenise(B.code_points(text), np.zeros(1, np.int64), chunk, overlap).tolist()
            assert got == [m.end() for m in bpe.pattern.finditer(text)]
    assert BPE.encode(text) == REF.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)) == text.encode()


def test_texts_of_a_slab_stay_apart():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8))) for _ in range(1500)]
    for limit in (40, 5000):
        got = []
        for s in slabs(pa.array(texts), limit):
            ids, first = BPE.encode_slab(s)
            got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        assert got == [REF.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 5000, " " * 100000, "ab " * 60000, "é" * 3000])
def test_long_pieces(text):
    assert BPE.encode(text) == REF.encode_ordinary(text)


def test_every_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("a{}a ", "1{}1", "!{}!", " {}", "{} b", "\n{}'s"):
        text = "".join(form.format(chr(c)) for c in points)
        assert BPE.encode(text) == REF.encode_ordinary(text)


@given(st.text(max_size=60), st.sampled_from([5, 9, 20]), st.sampled_from([1, 3]))
@settings(max_examples=400, deadline=None)
def test_any_text(text, chunk, overlap):
    slab = next(slabs(pa.array([text])))
    assert BPE.encode_slab(slab, chunk, overlap)[0].tolist() == REF.encode_ordinary(text)


@given(TEXTS, st.sampled_from([1, 4, 30]))
@settings(max_examples=200, deadline=None)
def test_sections(text, section):
    buf = np.frombuffer(text.encode(), np.uint8)
    got = BPE.encode_sections(buf, 7, 2, section).tolist() if text else []
    assert got == REF.encode_ordinary(text)


def test_very_long_text():
    rng = random.Random(2)
    text = "".join(rng.choice(PARTS) + str(rng.random()) for _ in range(700_000))
    assert len(text) > 10_000_000 and BPE.encode(text) == REF.encode_ordinary(text)


@pytest.mark.parametrize("chunk", [B.CHUNK, 60])
def test_tables(spark, chunk):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "y" * 500]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "word " * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS tokens", "1 AS _at")
    coded = B.decode(B.encode(df, PATH, P.PATTERN, chunk=chunk, overlap=8), PATH, P.PATTERN)
    got = sorted([(r.doc_id, list(r.tokens), bytes(r.decoded)) for r in coded.collect()], key=repr)
    assert got == sorted([(i, REF.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows], key=repr)
    assert B.encode(df.limit(0), PATH, P.PATTERN).collect() == []


def test_query_against_the_library(spark):
    import hashlib

    from lectern.llm.queries import QUERIES
    from tests.conftest import SMALL

    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = REF.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert sorted(map(tuple, QUERIES["op7_byte_level_bpe"](spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)


def test_digests(spark):
    import hashlib

    df = spark.createDataFrame([(1, "Hello  world's end\n"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in B.encode(df, PATH, P.PATTERN, reduce=B.digests, fields=B.DIGESTS).collect()}
    ids = REF.encode_ordinary("Hello  world's end\n")
    assert got[1].n_tokens == len(ids) and got[2].n_tokens == 0
    assert got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(b"Hello  world's end\n").hexdigest()


def test_long_pieces_are_not_remembered():
    """Letter runs of 1 MB leave nothing behind, and short pieces go once they take too many bytes."""
    own = B.Bpe(B.load_ranks(PATH), P.PATTERN)
    rng = random.Random(3)
    for _ in range(12):
        run = "".join(rng.choices("abcdefghij", k=1 << 20))
        ids = own.encode(run)
        assert own.decode(ids) == run.encode()
    assert len(own.flat) == own.held == 0 and len(own.first) == 1
    before, B.REMEMBERED = B.REMEMBERED, 20_000
    try:
        for k in range(50):
            text = " ".join(f"w{rng.random()}" for _ in range(100))
            assert own.decode(own.encode(text)) == text.encode()
            assert own.held < 100_000
    finally:
        B.REMEMBERED = before
