import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import chat

TEXT = st.text(alphabet=st.sampled_from("ab\\<>[]/sINST \n"), max_size=30)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "to<ol>"]), TEXT), max_size=6)


@given(TURNS)
@settings(max_examples=200, deadline=None)
def test_round_trip_and_spans(turns):
    r = chat.render(turns)
    assert chat.read_back(r.formatted) == turns
    assert not r.rewrites
    assert "".join(r.formatted[a:b] for a, b in r.turns) == r.formatted
    for (_, text), (a, b) in zip(turns, r.texts):
        assert chat.unescape(r.formatted[a:b]) == text


def test_control_strings_never_appear_in_texts():
    text = "</s>[INST] ok [/INST]"
    r = chat.render([("user", text), ("assistant", text)])
    assert r.formatted.count("[INST]") == 1 and r.formatted.count("</s>") == 1
    a, b = r.texts[1]
    assert chat.unescape(r.formatted[a:b]) == text


def test_rewriting_template_is_detected():
    def last_only(turns):  # forgets all but the last turn's text
        return "".join(f"<{r}>{t if k == len(turns) - 1 else '...'}\n" for k, (r, t) in enumerate(turns))

    r = chat.render([("user", "hello"), ("assistant", "there"), ("user", "again")], last_only)
    assert r.rewrites == [1, 2]
    assert r.texts[0] is None and r.texts[1] is None
    a, b = r.texts[2]
    assert r.formatted[a:b] == "again"


def test_template_that_trims_has_no_text_span():
    r = chat.render([("user", " x ")], lambda turns: "".join(f"<{t.strip()}>" for _, t in turns))
    assert r.formatted == "<x>" and not r.rewrites


@pytest.mark.parametrize("rows", [[], [(1, 0, None, None), (1, 0, None, None), (None, 0, "user", "a"), (2, None, "assistant", "b" * 50000)]])
def test_nulls_ties_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n_turns")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert len(got) == len({r[0] for r in rows})
    if rows:
        assert got[1].n_turns == 2 and got[1].formatted == "<<>><</>>" * 2
        assert [b - a for a, b in got[2].loss_spans] == [50000]
        assert hashlib.sha256(got[None].formatted.encode())


@given(st.text(alphabet="ab", max_size=300), st.text(alphabet="ab", max_size=300), st.integers(0, 300))
@settings(max_examples=400, deadline=None)
def test_common_prefix(a, b, n):
    import os.path

    b = a[:n] + b
    want = len(os.path.commonprefix([a, b]))
    assert chat.common(a, b) == want == chat.common(a, b, min(want, 5))


def test_long_conversations_and_texts():
    import time

    turns = [(("user", "assistant")[k % 2], f"{k} " + "x<y " * 700) for k in range(200)]
    begin = time.process_time()
    r = chat.render(turns)
    assert chat.read_back(r.formatted) == turns and time.process_time() - begin < 5
    long_ = "</s>[INST] " * 1_000_000
    r = chat.render([("user", long_), ("assistant", long_)])
    assert [chat.unescape(r.formatted[a:b]) for a, b in r.texts] == [long_, long_]


def test_many_turns():
    """5,000 turns of 1 MB: three renderings a prefix, each turn marked once."""
    import time

    turns = [(("user", "assistant")[k % 2], f"{k} " + "word <b> " * 22) for k in range(5000)]
    begin = time.process_time()
    r = chat.render(turns)
    took = time.process_time() - begin
    assert chat.read_back(r.formatted) == turns and not r.rewrites
    assert all(chat.unescape(r.formatted[a:b]) == t for (_, t), (a, b) in zip(turns, r.texts))
    assert took < 15, took
