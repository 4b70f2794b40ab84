import json
import os
import subprocess
import sys
import textwrap
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.models import ledger as ledgers
from lectern.models import scorers, tasks
from lectern.models.ledger import Ledger, said
from lectern.plans import pipelines


class Noted:
    """Writes a file for each call, so that calls of lost tasks are counted too."""

    def __init__(self, folder, answer, name="noted"):
        self.folder, self.answer, self.name = str(folder), answer, name
        os.makedirs(self.folder, exist_ok=True)

    def complete(self, prompt, image=None):
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(prompt)
        return self.answer(prompt)

    def asked(self):
        return sorted(open(os.path.join(self.folder, f)).read() for f in os.listdir(self.folder))


def test_one_call_for_equal_prompts(spark, tmp_path):
    model = Noted(tmp_path / "calls", lambda p: p.upper())
    rows = spark.createDataFrame([(k, f"p{k % 7}") for k in range(100)] + [(100, None)], "k int, p string")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    got = scorers.complete(rows, model, "p", "reply", ledger=ledger)
    assert {(r.k, r.reply) for r in got.collect()} == {(k, f"P{k % 7}") for k in range(100)} | {(100, "[No content received]")}
    got.count()
    assert model.asked() == [""] * 3 + [f"p{k}" for k in range(7)]
    again = scorers.complete(rows, model, "p", "reply", ledger=Ledger(spark, str(tmp_path / "ledger")))
    assert again.count() == 101 and len(model.asked()) == 10
    other = Noted(tmp_path / "others", lambda p: "x", "other")
    assert scorers.complete(rows, other, "p", "reply", ledger=ledger).where("reply = 'x'").count() == 101 and len(other.asked()) == 8


def test_tries_go_on_where_they_stopped(spark, tmp_path):
    def fail(prompt):
        raise RuntimeError("gone")

    rows, path = spark.createDataFrame([("a",), ("b",)], "p string"), str(tmp_path / "ledger")
    model = Noted(tmp_path / "calls", fail)
    got = scorers.complete(rows, model, "p", "reply", tries=2, ledger=Ledger(spark, path))
    assert [r.reply for r in got.collect()] == ["[Error: gone]"] * 2 and len(model.asked()) == 4
    scorers.complete(rows, model, "p", "reply", tries=2, ledger=Ledger(spark, path)).collect()
    assert len(model.asked()) == 4


def test_a_stopped_run_asks_only_the_rest(spark, tmp_path):
    flag = tmp_path / "stop"
    flag.write_text("")

    def answer(prompt):
        if prompt == "p7" and flag.exists():
            raise SystemExit("killed")  # takes the task with it
        return prompt

    model = Noted(tmp_path / "calls", answer)
    rows, path = spark.createDataFrame([(f"p{k}",) for k in range(60)], "p string"), str(tmp_path / "ledger")
    with pytest.raises(Exception):  # noqa: B017
        Ledger(spark, path, commit_calls=5, task_calls=5).ask(rows, model, "p")
    kept = {r.reply for r in Ledger(spark, path).calls().collect()} if os.path.exists(path) else set()
    before = set(model.asked())
    flag.unlink()
    got = Ledger(spark, path).ask(rows, model, "p", "calls").select("p", said(F.col("calls")).alias("reply")).collect()
    assert {r.p: r.reply for r in got} == {f"p{k}": f"p{k}" for k in range(60)}
    counts = {p: model.asked().count(p) for p in set(model.asked())}
    assert all(counts[p] == 1 for p in kept) and len(kept) >= len(before) - 20


def test_images_are_told_apart(spark, tmp_path):
    model = Noted(tmp_path / "calls", lambda p: "seen")
    rows = spark.createDataFrame([("p", b"a"), ("p", b"b"), ("p", b"a"), ("p", None)], "p string, content binary")
    scorers.complete(rows, model, "p", "reply", image="content", ledger=Ledger(spark, str(tmp_path / "l"))).collect()
    assert len(model.asked()) == 3


def test_empty(spark, tmp_path):
    rows = spark.createDataFrame([], "p string")
    got = scorers.complete(rows, scorers.Scripted({}, "x"), "p", "reply", ledger=Ledger(spark, str(tmp_path / "l")))
    assert got.columns == ["p", "reply"] and got.count() == 0
    assert Ledger(spark, str(tmp_path / "l")).calls().count() == 0


def test_whole_topics_asks_each_stage_once(spark, tmp_path):
    topic = {"title": "T", "description": "d", "start_s": 1, "end_s": 2, "start": 1, "end": 2, "coverage": [{"start_idx": 0, "end_idx": 1}]}

    def answer(prompt):
        stage, video = prompt.split("\n")[0], "v2" if "two" in prompt else "v1" if "one" in prompt else "v0"
        return json.dumps([topic]) if {"v0": "simple", "v1": "timed", "v2": "chunk"}[video] in stage else "nothing"

    model = Noted(tmp_path / "calls", answer)
    words = ["zero", "one", "two"]
    segments = spark.createDataFrame([(f"v{v}", k, 5.0 * k, 5.0 * k + 4, words[v]) for v in range(3) for k in range(4)], "video_id string, seg_idx int, start double, end double, text string")
    docs = segments.select("video_id").distinct()
    out = pipelines.whole_topics(docs, model, "simple", "timed", "chunk", segments)
    assert {r.video_id: r.mode for r in out.collect()} == {"v0": "whole_simple", "v1": "whole_timestamped", "v2": "chunked"}
    out.count()
    stages = [p.split("\n")[0] for p in model.asked()]
    assert (stages.count("simple"), stages.count("timed"), stages.count("chunk")) == (1 + 3 + 3, 1 + 3, 1)


def test_tasks_take_a_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    opinions = spark.createDataFrame([("l", 0, "good"), ("l", 1, "good")], "link string, seq int, paragraph string")
    model = Noted(tmp_path / "calls", lambda p: "like" if "dislike" in p else "no")
    got = tasks.ask_opinions(opinions, model, ledger=ledger)
    assert [r.other_reply for r in got.collect()] == ["no", "no"] and len(model.asked()) == 6


def test_commits_of_few_calls_are_no_jobs_of_their_own(spark, tmp_path):
    """Jobs don't grow with the number of commits, and what is asked but not written stays within the commit's calls."""
    tracker, path = spark.sparkContext.statusTracker(), str(tmp_path / "ledger")
    for n in (60, 240):
        rows, group = spark.createDataFrame([(f"p{k}",) for k in range(n)], "p string"), f"asked-{n}"
        spark.sparkContext.setJobGroup(group, group)
        assert Ledger(spark, f"{path}{n}", commit_calls=10, task_calls=5).ask(rows, scorers.Scripted({}, "x"), "p").count() == n
        assert len(tracker.getJobIdsForGroup(group)) < 20
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        sizes = [len(pq.read_table(os.path.join(d, f))) for d, _, fs in os.walk(f"{path}{n}") for f in fs]
        assert sum(sizes) == n and max(sizes) * 4 <= 10  # four tasks at once


def test_many_files_are_written_once_more_in_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledgers, "MANY", 10)
    model, path = Noted(tmp_path / "calls", lambda p: p), str(tmp_path / "ledger")
    rows = spark.createDataFrame([(f"p{k}",) for k in range(50)], "p string")
    assert scorers.complete(rows, model, "p", "reply", ledger=Ledger(spark, path, commit_calls=4)).count() == 50
    few = [d for d in os.listdir(path) if d.endswith(ledgers.FEW)]
    assert len(few) == 1 and len(os.listdir(path)) == 2 and Ledger(spark, path).calls().count() == 50
    os.remove(f"{path}/{few[0]}/_SUCCESS")  # as if it had been stopped there
    assert Ledger(spark, path).calls().count() == 50
    scorers.complete(rows, model, "p", "reply", ledger=Ledger(spark, path)).count()
    assert len(model.asked()) == 50


def test_a_task_that_runs_again_goes_on_behind_its_files(tmp_path):
    script = textwrap.dedent(f"""
        import os, uuid
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from lectern.models.ledger import Ledger
        class Dying:
            def complete(self, prompt, image=None):
                open({str(tmp_path)!r} + "/asked-" + uuid.uuid4().hex, "w").write(prompt)
                if prompt == "p17" and TaskContext.get().attemptNumber() == 0:
                    os._exit(1)
                return prompt
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        rows = spark.createDataFrame([(f"p{{k}}",) for k in range(40)], "p string")
        ledger = Ledger(spark, {str(tmp_path / "ledger")!r}, commit_calls=6, task_calls=10)
        print(ledger.ask(rows, Dying(), "p").count(), ledger.calls().count())
    """)
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": home})
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split() == ["40", "40"]
    asked = [open(tmp_path / f).read() for f in os.listdir(tmp_path) if f.startswith("asked-")]
    assert len(set(asked)) == 40 and 41 <= len(asked) <= 43
