import json

from pyspark.sql import functions as F

from lectern.functions import text
from lectern.models import scorers, tasks
from lectern.operators import opinions
from lectern.sources import correlations


class Answers:
    def complete(self, prompt, image=None):
        if image is not None:
            return f"a picture of {len(image)} bytes"
        if "like or dislike" in prompt:
            return "like" if "good" in prompt else "dislike"
        if "Begin with yes" in prompt:
            return "Yes: by hand" if "hand" in prompt.split("\n\n")[1] else "no"
        return "reading"


def test_opinions(spark):
    rows = [("l", 0, "good by hand"), ("l", 1, "good book"), ("l", 2, "poor")]
    asked = tasks.ask_opinions(spark.createDataFrame(rows, "link string, seq int, paragraph string"), Answers())
    labels = {r.seq: r for r in opinions.label(asked, compat=False).collect()}
    assert [labels[k].sentiment for k in range(3)] == ["like", "like", "dislike"]
    assert [labels[k].other_paradigm for k in range(3)] == [None, "reading", None]
    assert labels[0].embodied_reason == "by hand"


def test_captions(spark, tmp_path):
    d = tmp_path / "v" / "raw_frames"
    d.mkdir(parents=True)
    for k in range(3):
        (d / f"frame_000{k}.jpg").write_bytes(b"x" * (k + 1))
    done = spark.createDataFrame([("v", "frame_0000.jpg")], "video_id string, frame string")
    got = tasks.caption_frames(spark, str(tmp_path), Answers(), "what is it", done)
    doc = tasks.captions_document(got).first()
    assert [(f.frame_id, f.caption) for f in doc.frames] == [("frame_0001.jpg", "a picture of 2 bytes"), ("frame_0002.jpg", "a picture of 3 bytes")]
    pairs = spark.createDataFrame([("v", "f", "one", "two")], "video_id string, frame string, caption_a string, caption_b string")
    assert tasks.merge_captions(pairs, scorers.Scripted({}, "So.\nFinal Caption: both"), F.col("caption_b")).first().caption == "both"
    assert tasks.merge_captions(pairs, scorers.Scripted({}, "no"), F.col("caption_b")).first().caption == "one"


def test_media(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"12")
    (tmp_path / "b.mp4").write_bytes(b"x")
    got = {r.video_id: r.fps for r in tasks.probe_files(spark, str(tmp_path), lambda c: float(c), "fps").collect()}
    assert got == {"a": 12.0, "b": None}
    said = {r.video_id: r.segments for r in tasks.transcribe(spark, str(tmp_path), lambda c: [(0.0, float(c), "hi")]).collect()}
    assert said["b"] is None and said["a"][0].end == 12.0


def test_streamed_replies():
    parts = lambda p: iter([{"content": "a"}, {"content": "b"}, {"error": "lost"}, {"content": "c"}])
    assert tasks.Streamed(parts).complete("x") == "ab[Error: lost]"


SHAPES = {
    "unit": ({"candidates": [{"comment": " a ", "score": 5}, {"text": "b", "score": "6"}, 7]}, [("a", 5.0), ("b", None)]),
    "units": ([{"candidates": [{"body": "c", "score": True}]}, {"x": 1}, 3], [("c", 1.0)]),
    "other": ({"results": [{"comment": "d", "score": 1, "matches": [{"comment": "e", "score": 2}]}]}, []),
}


def test_correlation_documents(spark, tmp_path):
    for name, (value, _) in SHAPES.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "bad.json").write_text("{")
    rows = correlations.documents(spark, str(tmp_path)).collect()
    got = {n: [(r.comment, r.score) for r in rows if r.file.endswith(f"/{n}.json")] for n in SHAPES}
    assert got == {n: want for n, (_, want) in SHAPES.items()}
    old = [(r.comment, r.score) for r in correlations.documents(spark, str(tmp_path), legacy=True).collect() if r.file.endswith("/other.json")]
    assert old == [("d", 1.0), ("e", 2.0)]
    assert [c["score"] for c in correlations.leaves([[{"items": [{"candidates": [{"score": 1}]}, 5]}], {"score": 2}])] == [1, 2]


def test_renaming(spark):
    df = spark.createDataFrame([("v_raw.docx",), ("v.txt",)], "c string")
    assert [r[0] for r in df.select(text.renamed(F.col("c"), "_raw.docx", "_captions.docx")).collect()] == ["v_captions.docx", "v.txt"]


def test_extraction_passes_columns_through(spark):
    """More rows than are read at once, with columns of other kinds; the second try is the one that reads."""
    from pyspark.sql import functions as F

    from lectern.functions import replies
    from lectern.models import scorers


    class Model:
        def complete(self, prompt, image=None):
            return '[{"title": "T", "description": "d", "start": 1, "end": 2}]' if prompt.endswith(scorers.HINT) else "none"

    rows = spark.range(2500).select("id", F.current_timestamp().alias("at"), F.concat(F.lit("p"), "id").alias("prompt"))
    got = scorers.extract_with_retries(rows, Model(), "prompt").select("id", F.size("extracted.attempts").alias("n"), F.col("extracted.parsed")[0]["title"].alias("t")).collect()
    assert sorted((r.id, r.n, r.t) for r in got) == [(k, 2, "T") for k in range(2500)]
