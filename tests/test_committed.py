import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from lectern.sinks import committed, files


def tree(home):
    return {os.path.relpath(os.path.join(d, f), home): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(home) for f in fs if not d.endswith("/_commits") and f[0] != "."}


def test_round_trip(spark, tmp_path):
    rows = [(f"v{k % 3}/raw/f{k}.txt", f"text {k}") for k in range(40)] + [("empty.txt", None)]
    home = str(tmp_path / "out")
    assert files.write_named(spark.createDataFrame(rows, "name string, text string"), home) == 41
    assert tree(home) == {n: (t or "").encode() for n, t in rows}
    assert files.write_named(spark.createDataFrame([("v0/raw/f0.txt", "new"), ("v9/x", "y")], "name string, text string"), home) == 2
    assert tree(home) == {n: (t or "").encode() for n, t in rows} | {"v0/raw/f0.txt": b"new", "v9/x": b"y"}
    assert not [d for d in os.listdir(home) if d.startswith("_staging")]


def test_nothing_is_left_by_a_failure(spark, tmp_path):
    home = str(tmp_path / "out")
    rows = spark.range(200).repartition(4).select(F.concat("id", F.lit(".txt")).alias("name"), F.when(F.col("id") == 150, F.raise_error(F.lit("stop")).cast("string")).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="stop"):
        files.write_named(rows, home)
    assert tree(home) == {} if os.path.exists(home) else True
    assert not os.path.exists(home) or not [d for d in os.listdir(home) if d.startswith("_staging")]


@pytest.mark.parametrize("names", [["a.txt", "a.txt"], ["d/a", "d/a"], ["d", "d/a"]])
def test_names_that_clash(spark, tmp_path, names):
    home = str(tmp_path / "out")
    for parts in (1, 2):
        rows = spark.createDataFrame([(n, str(k)) for k, n in enumerate(names)], "name string, text string").repartitionByRange(parts, "text")
        with pytest.raises(Exception):  # noqa: B017
            files.write_named(rows, home)
        assert tree(home) == {} if os.path.exists(home) else True


@pytest.mark.parametrize("name", ["", None, "../x", "/x", "a//b", "_hidden/x", "."])
def test_names_outside_the_folder(spark, tmp_path, name):
    with pytest.raises(Exception, match="no name of a file"):
        files.write_named(spark.createDataFrame([(name, "x")], "name string, text string"), str(tmp_path / "out"))


def test_overwrite_waits_for_the_commit(spark, tmp_path):
    home = str(tmp_path / "out")
    committed.register(spark)
    write = lambda rows: spark.createDataFrame(rows, "name string, content binary").write.format("named_files").option("path", home).mode("overwrite").save()
    write([("a", b"1"), ("d/b", b"2")])
    write([("c", b"3")])
    assert tree(home) == {"c": b"3"}
    with pytest.raises(Exception):  # noqa: B017
        write([("d", b"4"), ("..", b"5")])
    assert tree(home) == {"c": b"3"}


def test_a_job_commits_once(tmp_path):
    home = str(tmp_path / "out")
    writer = committed.NamedFilesWriter(home, "job", False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"name": ["a/b", "c"], "content": [b"1", b"22"]})
    done = writer.write(iter([batch]))
    killed = writer.write(iter([batch]))  # an attempt whose message never arrives
    assert os.path.exists(killed.folder)
    writer.commit([done, None])
    writer.commit([done, None])
    assert tree(home) == {"a/b": b"1", "c": b"22"}
    assert committed.receipt(home, "job") == {"files": 2, "bytes": 3}
    assert sorted(os.listdir(home)) == ["_commits", "a", "c"]


def test_a_killed_worker_is_tried_again(tmp_path):
    """A Python worker dies in the middle of its first attempt; the second one writes all, once."""
    script = textwrap.dedent(f"""
        import os, sys, json
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from pyspark import TaskContext
        from pyspark.sql import SparkSession, functions as F
        from lectern.sinks import committed, files
        class Dying(committed.NamedFilesWriter):
            def write(self, iterator):
                def some():
                    for batch in iterator:
                        yield batch.slice(0, 3)
                        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
                            os._exit(1)
                        yield batch.slice(3)
                return super().write(some())
        class DyingFiles(committed.NamedFiles):
            @classmethod
            def name(cls):
                return "dying_files"
            def writer(self, schema, overwrite):
                return Dying(self.options["path"], self.options["job"], overwrite)
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        spark.dataSource.register(DyingFiles)
        rows = spark.range(0, 40, 1, 2).select(F.concat("id", F.lit(".txt")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
        rows.write.format("dying_files").option("path", {str(tmp_path / "out")!r}).option("job", "j").mode("append").save()
        print(json.dumps(committed.receipt({str(tmp_path / "out")!r}, "j")["files"]))
    """)
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, env=env)
    assert done.returncode == 0, done.stderr[-3000:]
    assert json.loads(done.stdout.splitlines()[-1]) == 40
    assert tree(tmp_path / "out") == {f"{k}.txt": str(k).encode() for k in range(40)}
    assert "Lost task 1.0" in done.stderr
    assert sorted(d for d in os.listdir(tmp_path / "out") if d.startswith("_")) == ["_commits"]


def test_no_file_is_moved_by_the_driver(spark, tmp_path):
    """A job of tasks moves the files, and no task has all of them."""
    home, group = str(tmp_path / "out"), "moved"
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    assert files.write_named(spark.range(0, 400, 1, 2).select(F.concat("id", F.lit(".txt")).alias("name"), F.lit("x").alias("text")), home) == 400
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert any(s.numTasks >= 4 for s in stages if s)
    assert len(os.listdir(home)) == 401


def test_moving_a_file_again_changes_nothing(tmp_path):
    target, base = committed.located(str(tmp_path))
    (tmp_path / "staged").write_text("new")
    (tmp_path / "name").write_text("old")
    for _ in range(2):  # the second attempt finds it moved
        committed.put(target, f"{base}/staged", f"{base}/name")
        assert (tmp_path / "name").read_text() == "new" and not (tmp_path / "staged").exists()
    with pytest.raises(OSError):
        committed.put(target, f"{base}/staged", f"{base}/other")


def test_clashes(spark):
    names = lambda *n: committed.clashes(spark.createDataFrame([(x,) for x in n], "name string"))
    assert names("a", "b/a", "b/c/a", "ab", "a.b/c").collect() == []
    assert {r.name for r in names("a", "a", "d/e", "d/e/f/g", "x/y", "x").collect()} == {"a", "d/e", "x"}
