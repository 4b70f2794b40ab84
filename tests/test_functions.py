import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.functions import replies, text, times, urls, vectors


def values(spark, data, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(data)], f"k int, c {kind}")
    return [r[0] for r in df.select("k", expr(F.col("c")).alias("v")).orderBy("k").select("v").collect()]


def test_hms(spark):
    got = values(spark, [0.0, -3.0, 59.9996, 3661.0625, 1.0005, 90000.5], times.hms, "double")
    assert got == ["00:00:00.000", "00:00:00.000", "00:00:59.1000", "01:01:01.062", "00:00:01.000", "25:00:00.500"]
    assert values(spark, [59.9996], lambda c: times.hms(c, carry=True), "double") == ["00:01:00.000"]
    assert values(spark, [5.25], times.srt, "double") == ["00:00:05,250"]


def test_seconds(spark):
    assert values(spark, ["1:02:03,5", "02:03", "7.25", "x", "1:2:3:4", "", "1.5:30"], times.seconds) == [3723.5, 123.0, 7.25, None, None, None, None]
    r = values(spark, ["00:01–00:02:03.5", "1-2-3"], times.time_range)
    assert [(x.start_s, x.end_s) for x in r] == [(1.0, 123.5), (1.0, None)]


def test_video_ids(spark):
    data = ["see https://youtu.be/AAAAAAAAAA1?t=3).", "(https://www.youtube.com/watch?v=BBBBBBBBBB2&t=1)", "https://www.youtube.com/embed/CCCCCCCCCC3/x", "https://example.com/?v=DDDDDDDDDD4", "youtu but none", None, "https://m.youtube.com/watch?a=1&v=EEEEEEEEEE5,"]
    assert values(spark, data, urls.video_id) == ["AAAAAAAAAA1", "BBBBBBBBBB2", "CCCCCCCCCC3", None, None, None, "EEEEEEEEEE5"]
    assert values(spark, ["abcdef?x", "ab?c", "abc-_1"], urls.clean_id) == ["abcdef", "ab?c", "abc-_1"]
    assert values(spark, ["AAAAAAAAAA1", "short", None, "AAAAAAAAAA1 "], urls.is_id) == [True, False, False, False]
    assert values(spark, ["/r/v1/raw_frames/", "/r/v2", "v3/frames"], urls.dir_id) == ["v1", "v2", "v3"]
    assert values(spark, ["https://y.com/watch?v=abc&t=1", "https://youtu.be/xyz?t=1"], urls.shell_id) == ["abc", "xyz"]


def test_text(spark):
    assert values(spark, ["  a  \n b\t", ""], text.squeeze) == ["a b", ""]
    long = "word " * 200
    got = values(spark, [long, "x" * 700, "short  one"], text.summarise)
    assert got[0] == ("word " * 120).strip()[: len(got[0]) - 4] + " ..." and got[1] == "x" * 600 + " ..." and got[2] == "short one"
    assert values(spark, ["a \r\n b\n\n\n c  d\n\n \n\ne"], text.paragraphs) == [["a b", "c d", "e"]]
    assert values(spark, ["a b_c é1", None], text.word_count) == [3, 0]
    assert values(spark, [" Yes", "1", "no", None, "T"], text.truthy) == [True, True, False, False, True]
    assert values(spark, [1.23456, None], lambda c: text.fixed(c, 3, "—"), "double") == ["1.235", "—"]
    assert values(spark, ["[Error: x]", "fine", None], text.is_error) == [True, False, False]
    assert values(spark, ["talk\nFinal Caption: the\nend", "none"], lambda c: text.final_caption(c, F.lit("first"))) == ["the\nend", "first"]


REPLIES = [
    ('{"correlated": true, "score": 80, "reason": "x"}', (True, 80, "x")),
    ('text {"correlated":"Yes","score":"72","reason":""} tail', (True, 72, "")),
    ('{"score": 80.7}', (False, 80, "")),
    ('{"score": "80.7"}', (False, 80, '{"score": "80.7"}')),
    ('{"score": null, "correlated": true}', (False, 0, '{"score": null, "correlated": true}')),
    ('{"score": {"v": 1}, "correlated": "Yes"}', (True, 1, '{"score": {"v": 1}, "correlated": "Yes"}')),
    ("Yes, score 1234", (True, 100, "Yes, score 1234")),
    ("", (False, 0, "")),
    (None, (False, 0, "")),
    ('{"correlated": 1, "score": -5}', (True, 0, "")),
    ('{"correlated": false}', (False, 0, "")),
]


def test_score_replies(spark):
    got = values(spark, [r for r, _ in REPLIES], replies.score_reply)
    assert [tuple(g) for g in got] == [w for _, w in REPLIES]


def test_sentiment(spark):
    data = ["I like it", "Dislike", "neither"]
    assert values(spark, data, replies.sentiment) == ["like", "like", None]
    assert values(spark, data, lambda c: replies.sentiment(c, compat=False)) == ["like", "dislike", None]
    got = values(spark, ["Yes: hands-on", "yes, because\nmore", "well yes", "No"], replies.embodied)
    assert got == [Row(is_embodied=True, reason="hands-on"), Row(is_embodied=True, reason=", because"), Row(is_embodied=True, reason=None), Row(is_embodied=False, reason=None)]


def test_topic_replies():
    good = '```json\n[{"title": "A", "summary": "b", "time_range": "00:01–00:10", "quotes": ["1", "2", "3", "4"]}, {"topic": "no time", "description": "x"}]\n```'
    topics, error = replies.topics_of(good)
    assert error is None and topics == [{"title": "A", "description": "b", "evidence_quotes": ["1", "2", "3"], "start_s": 1.0, "end_s": 10.0, "coverage": None}]
    assert [t["start_s"] for t in replies.topics_of('[{"title": "A", "description": "b", "start": "2", "end_local": 3}]')[0]] == [2.0]
    assert replies.topics_of('[{"title": 5, "description": "b"}]')[0] is None
    whole = '[{"title": "B", "description": "b", "start_s": 5, "end_s": 9}, {"title": "A", "description": "b", "start_s": 1, "end_s": 2}, {"title": "C", "description": "c", "start_s": 3}]'
    assert [t["title"] for t in replies.topics_of(whole, "whole")[0]] == ["A", "B"]
    simple = replies.topics_of('[{"title": "A", "description": "b", "coverage": [{"start_idx": "4", "end_idx": 2}, {"start_idx": 1}, 7]}]', "simple")[0]
    assert simple[0]["coverage"] == [{"start_idx": 4, "end_idx": 2}]
    assert replies.topics_of("[]") == ([], None)
    assert replies.topics_of("prose")[0] is None
    assert replies.topics_of('[{"title": "A", "description": "b", "time_range": "soon-later"}]')[0] is None
    assert replies.json_array('x {"a": 1} y {"b": 2}') == [{"a": 1}, {"b": 2}]
    assert replies.outline_of("lost\n## One\n- first\n* second\n**Two**\ntext") == [{"title": "One", "description": "first second"}, {"title": "Two", "description": "text"}]


@pytest.mark.parametrize("n,k,want", [(0, 3, []), (2, 3, [0, 1]), (10, 3, [0, 4, 9]), (5, 4, [0, 1, 3, 4]), (7, 1, [0]), (4, 3, [0, 2, 3])])
def test_evenly(spark, n, k, want):
    assert spark.range(1).select(vectors.evenly(F.lit(n), k)).first()[0] == want


def test_dot_and_jaccard(spark):
    row = spark.range(1).select(vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), vectors.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), vectors.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()
    assert tuple(row) == (11.0, 0.5, 0.0)


def test_base64_is_one_line(spark):
    import base64

    data = ["", "x" * 57, "x" * 58, "é" * 400]
    assert values(spark, data, lambda c: text.base64(F.encode(c, "UTF-8"))) == [base64.b64encode(x.encode()).decode() for x in data]


def test_decimals_as_python_prints_them(spark):
    import random

    r = random.Random(3)
    data = [44.3125, 45.8125, -44.3125, 1.0005, 1.0015, 1.0035, 0.0005, -0.0001, 0.0, 1e18, 2.0**49, 123456.7895]
    data += [r.randrange(100 * d) / d for d in (16, 80, 400, 2000, 48) for _ in range(400)]
    for digits in (1, 2, 3):
        assert values(spark, data, lambda c: text.fixed(c, digits), "double") == [f"{x:.{digits}f}" for x in data]
