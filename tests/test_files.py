import json
import os

import pytest
from pyspark.sql import functions as F

from lectern import schemas
from lectern.models import scorers
from lectern.operators import coverage
from lectern.plans import pipelines
from lectern.sinks import committed, report
from lectern.sinks import files as sinks
from lectern.sources import docx, files, replay
from lectern.streaming import incremental

DOC = {"video_id": "AAAAAAAAAA1", "url": "https://www.youtube.com/watch?v=AAAAAAAAAA1", "title": "T", "category": "C", "fps": None, "segments": [{"start": 0.0, "end": 2.0, "text": "hello arm"}, {"start": 2.0, "end": 59.9996, "text": ""}, {"start": 60.0, "end": 905.5, "text": "tighten the joint"}]}


@pytest.fixture
def tree(tmp_path):
    for d in ("transcripts", "topics", "txt", "srt", "frames/AAAAAAAAAA1/raw_frames"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "transcripts/a.json").write_text(json.dumps(DOC))
    (tmp_path / "transcripts/BBBBBBBBBB2.json").write_text(json.dumps({"url": "", "segments": []}))
    (tmp_path / "topics/AAAAAAAAAA1.topics.json").write_text(json.dumps({"topics": [{"title": "x", "description": "d"}, {"id": "K", "title": " y ", "description": "s", "start_s": 1.0}]}))
    (tmp_path / "txt/AAAAAAAAAA1.txt").write_text("T\nhttps://u\nC\n\nhello arm\n\ntighten the joint\n")
    (tmp_path / "txt/empty.txt").write_text("")
    (tmp_path / "srt/AAAAAAAAAA1.srt").write_text("1\n00:00:00,000 --> 00:00:02,000\nhello arm\n\n2\n00:00:02,000 --> 00:00:59,1000\n\n\n3\n00:01:00,000 --> 00:15:05,500\ntighten the joint\n")
    for n in ("frame_0000.jpg", "frame_0001.PNG", "x_results.results.jsonl", "notes.md"):
        (tmp_path / "frames/AAAAAAAAAA1/raw_frames" / n).write_text("")
    return tmp_path


def test_transcripts_and_sinks(spark, tree):
    docs = files.transcripts(spark, str(tree / "transcripts"))
    assert {r.video_id: r.error for r in docs.collect()} == {"AAAAAAAAAA1": None, "BBBBBBBBBB2": "no segments"}
    assert [r.video_id for r in files.transcripts(spark, str(tree / "transcripts"), 0, 1).collect()] == ["BBBBBBBBBB2"]
    seg = files.segments(docs)
    srt = sinks.srt_txt(seg).first().text
    assert srt == "1\n00:00:00,000 --> 00:00:02,000\nhello arm\n\n2\n00:00:02,000 --> 00:00:59,1000\n\n\n3\n00:01:00,000 --> 00:15:05,500\ntighten the joint\n\n"
    assert sinks.timestamped_txt(seg, docs).first().text.startswith("T\nhttps://www.youtube.com/watch?v=AAAAAAAAAA1\nC\n\n[00:00:00.000 → 00:00:02.000] hello arm\n")
    assert sinks.timestamped_txt(seg).first().text.startswith("[00:00:00.000 → 00:00:02.000] hello arm\n")
    assert sinks.plain_txt(docs.where("error is null")).first().text == "T\nhttps://www.youtube.com/watch?v=AAAAAAAAAA1\nC\nhello arm  tighten the joint"
    back = json.loads(sinks.pretty_json(docs.where("error is null").select(*[c.split()[0] for c in schemas.TRANSCRIPT.split(", ")])).first().text)
    assert back == DOC
    sinks.write_texts(sinks.srt_txt(seg), str(tree / "out"))
    assert spark.read.text(str(tree / "out"), wholetext=True).count() == 1


def test_texts_and_subtitles(spark, tree):
    got = {r.file: r for r in files.transcript_texts(spark, str(tree / "txt")).collect()}
    assert got["AAAAAAAAAA1"].body == "hello arm\n\ntighten the joint" and got["empty"].title is None
    cues = files.subtitles(spark, str(tree / "srt")).orderBy("seg_idx").collect()
    assert [(c.seg_idx, c.start, c.text) for c in cues] == [(0, 0.0, "hello arm"), (1, 2.0, ""), (2, 60.0, "tighten the joint")]


def test_topics(spark, tree):
    got = files.topics(spark, str(tree / "topics")).orderBy("pos").collect()
    assert [(r.video_id, r.topic_id, r.title, r.description) for r in got] == [("AAAAAAAAAA1", "T1", "x", "d"), ("AAAAAAAAAA1", "K", "y", "s")]
    rows = [("/f/A/raw_frames/A.topics.json", "frames", "A.topics"), ("/s/A.json", "sibling", "A"), ("/r/B.json", "root", "B")]
    found = files.topics_lookup(spark.createDataFrame([("A",), ("B",), ("C",)], "video_id string"), spark.createDataFrame(rows, "path string, dir_kind string, stem string"))
    assert {r.video_id: r.path for r in found.collect()} == {"A": "/f/A/raw_frames/A.topics.json", "B": "/r/B.json"}


def test_listing(spark, tree):
    found = files.listing(spark, str(tree / "frames"))
    assert sorted(r.frame for r in files.frames(found).collect()) == ["frame_0000.jpg", "frame_0001.PNG"]
    assert {r.video_id for r in files.frames(found).collect()} == {"AAAAAAAAAA1"}
    assert [r.path.rsplit("/", 1)[1] for r in files.correlation_files(found).collect()] == ["x_results.results.jsonl"]


RECORDS = [
    '{"video_id":"A","topic_id":"T1","checked_pairs":1,"candidates":[{"correlated":false,"score":10,"comment":"old"}]}', "", "not json", "[1]",
    '{"video_id":"A","topic_id":"T1","checked_pairs":2,"candidates":[{"correlated":"Yes","score":"80","reason":"r","comment":"c"},{"correlated":false,"score":true,"text":"d"}]}',
    '{"video_id":"A","topic_id":"T2","checked_pairs":0,"candidates":[]}',
]


def test_results(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(RECORDS))
    r = files.results(spark, str(tmp_path))
    assert coverage.total_pairs(r).first().total_pairs == 3
    got = files.candidates(files.latest(r)).orderBy("cand_idx").collect()
    assert [(c.correlated, c.score, c.comment) for c in got] == [(True, None, "c"), (False, 1.0, "d")]  # a quoted number is no score
    shape = files.candidates(r)
    assert files.best_file(shape).first().file.endswith("a.jsonl")


def test_external_tables(spark, tmp_path):
    (tmp_path / "x.csv").write_text("video_id,Total Likes\nv,1\nv,2\n")
    assert files.external_table(spark, str(tmp_path / "x.csv")).dtypes == [("video_id", "string"), ("Total Likes", "string")]
    for body in ([{"video_id": "v", "n": 1}], {"rows": [{"video_id": "v", "n": 1}]}, {"any": {"video_id": "v", "n": 1}}):
        (tmp_path / "x.json").write_text(json.dumps(body))
        assert [(r.video_id, r.n) for r in files.external_table(spark, str(tmp_path / "x.json")).collect()] == [("v", "1")]
    assert files.external_table(spark, str(tmp_path / "x.odd")).count() == 0
    (tmp_path / "terms.txt").write_text("a\n\n b \nc\n")
    assert [r.phrase for r in files.search_terms(spark, str(tmp_path / "terms.txt"), 1).collect()] == ["b", "c"]
    (tmp_path / "raw.jsonl").write_text('{"text": "x"}\n')
    assert files.raw_comments(spark, str(tmp_path / "raw.jsonl")).first().text == "x"


def test_metadata(spark):
    v = spark.createDataFrame([("AAAAAAAAAA1",), ("b",)], "video_id string")
    info = spark.createDataFrame([("b", "", "https://o", "", ["Education"])], "video_id string, webpage_url string, original_url string, title string, categories array<string>")
    got = {r.video_id: tuple(r)[1:] for r in files.metadata(v, info).collect()}
    assert got == {"AAAAAAAAAA1": ("https://www.youtube.com/watch?v=AAAAAAAAAA1", "AAAAAAAAAA1", "Unknown Category"), "b": ("https://o", "b", "Education")}


def test_docx_round_trip(spark, tmp_path):
    rows = [{"kind": "heading", "level": 1, "text": "A & B"}, {"kind": "paragraph", "level": 0, "text": "x < y"}, {"kind": "page_break", "level": 0, "text": ""}]
    (tmp_path / "a.docx").write_bytes(report.docx(rows))
    (tmp_path / "bad.docx").write_bytes(b"no")
    got = docx.paragraphs(spark, str(tmp_path)).orderBy("para_no").collect()
    assert [(r.style, r.text) for r in got] == [("Heading1", "A & B"), ("", "x < y"), ("", "\n")]
    docx.register_udtf(spark)
    spark.read.format("binaryFile").load(str(tmp_path / "a.docx")).createOrReplaceTempView("f")
    assert spark.sql("SELECT p.text FROM f, LATERAL docx_paragraphs(content) p").count() == 3


def test_replayed_search(spark, tmp_path):
    rows = [{"phrase": "p", "page": k // 2, "video_id": v, "title": "a,b"} for k, v in enumerate("xyxzw")] + [{"phrase": "q", "video_id": "x"}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)))
    replay.register(spark)
    got = spark.read.format("replayed_search").option("path", str(tmp_path / "s.jsonl")).option("target", 3).load().collect()
    assert sorted((r.phrase, r.seq, r.video_id) for r in got) == [("p", 0, "x"), ("p", 1, "y"), ("p", 2, "z"), ("q", 0, "x")]


def flow(spark):
    videos = spark.createDataFrame([("v",), ("w",)], "video_id string")
    topics = spark.createDataFrame([("v", "T1", "joint", "loose joint"), ("v", "T2", "wire", "red wire"), ("w", "T1", "x", "y")], "video_id string, unit_id string, title string, description string")
    comments = spark.createDataFrame([("v", 0, "the joint was loose", "u"), ("v", 1, "a red wire", "u"), ("v", 2, "nothing", "u")], "video_id string, comment_idx int, comment string, url string")
    return videos, topics, comments


def test_correlation_flow_and_report(spark):
    videos, topics, comments = flow(spark)
    c = pipelines.correlate(videos, topics, comments, k=2, min_score=30).cache()
    assert c.groupBy("video_id", "unit_id").count().where("count = 2").count() == 3  # w has none of its own and gets all
    best = {(r.unit_id): r.comment for r in coverage.kept_comments(c, 30, 1).where("video_id = 'v'").collect()}
    assert best == {"T1": "the joint was loose", "T2": "a red wire"}
    records = pipelines.result_records(c)
    assert [r.checked_pairs for r in records.collect()] == [2, 2, 2]
    # a second run scores nothing
    assert pipelines.correlate(videos, topics, comments, records, k=2).count() == 0
    units = topics.withColumn("pos", F.col("unit_id"))
    frames = spark.createDataFrame([("v", f"f{k}") for k in range(9)], "video_id string, frame string")
    rep = report.correlation_report(units, c, records, comments, frames, min_score=30)
    text = [r.text for r in rep.where("video_id = 'v'").orderBy("seq").collect()]
    assert text[0] == "Correlation report: v" and "Pairs checked: 4" in text[1] and text[-1] == "f0,f4,f8"
    assert len(report.documents(rep).collect()) == 2
    assert report.combined_document(rep).where("kind = 'page_break'").count() == 2


def test_replay_scorer(spark):
    pairs = spark.createDataFrame([("v", "T1", "a"), ("v", "T1", "b")], "video_id string, unit_id string, comment string")
    recorded = spark.createDataFrame([("v", "T1", "a", True, 80, "r")], "video_id string, unit_id string, comment string, correlated boolean, score int, reason string")
    assert [(r.comment, r.score) for r in scorers.score_by_replay(pairs, recorded).collect()] == [("a", 80)]
    model = scorers.Scripted({}, '{"correlated": "yes", "score": 61}')
    assert [(r.correlated, r.score) for r in scorers.score_by_model(pairs, model, F.col("comment")).collect()] == [(True, 61)] * 2


class Failing:
    def complete(self, prompt, image=None):
        raise TimeoutError("slow")


GOOD = '[{"title": "A", "description": "b", "time_range": "0:01-0:09", "coverage": [{"start_idx": 0, "end_idx": 9}]}]'


def test_extraction_retries_and_cascade(spark):
    rows = spark.createDataFrame([("v", 0, "p")], "video_id string, chunk_index int, prompt string")
    bad = scorers.extract_with_retries(rows, Failing(), "prompt", 2)
    assert [(r.error, len(r.attempts)) for r in pipelines.failures(bad).collect()] == [("no JSON array", 2)]
    seg = spark.createDataFrame([("v", 0, 0.0, 5.0, "x"), ("w", 0, 10.0, 15.0, "y"), ("w", 1, 1000.0, 1001.0, "z")], "video_id string, seg_idx int, start double, end double, text string")
    got = pipelines.topics_by_chunk(seg, scorers.Scripted({}, GOOD), "find")
    assert sorted((r.video_id, r.start_s, r.end_s) for r in got.collect()) == [("v", 1.0, 9.0), ("w", 11.0, 19.0), ("w", 1001.0, 1009.0)]
    docs = seg.select("video_id").distinct()
    whole = pipelines.whole_topics(docs, scorers.Scripted({}, GOOD), "a", "b", "c", seg)
    assert {(r.video_id, r.mode) for r in whole.collect()} == {("v", "whole_simple"), ("w", "whole_simple")}
    none = pipelines.whole_topics(docs, scorers.Scripted({}, "[]"), "a", "b", "c", seg)
    assert none.count() == 0


def test_stream_scores_once(spark, tmp_path):
    units = spark.createDataFrame([("v", f"T{k}", float(k)) for k in range(6)], "video_id string, unit_id string, value double")
    home = str(tmp_path)
    score = lambda df: df.withColumn("score", F.col("value") * 2)
    for part in (units.where("value < 3"), units):  # the second file repeats the first's units
        part.coalesce(1).write.mode("append").parquet(f"{home}/in")
        incremental.score_stream(incremental.paced(spark, f"{home}/in", "video_id string, unit_id string, value double"), score, f"{home}/out", f"{home}/state").awaitTermination()
    assert spark.read.parquet(f"{home}/out").count() == 6


def test_tables_and_logs(spark, tmp_path):
    m = spark.createDataFrame([("v", 3, 1.5), ("w", 0, None)], "video_id string, frames int, corr_avg double")
    sinks.write_csv(m, str(tmp_path / "m"))
    assert {r.value for r in spark.read.text(str(tmp_path / "m")).collect()} == {"video_id,frames,corr_avg", "v,3,1.5", "w,0,"}
    blob = json.loads(sinks.metrics_json(m, m.groupBy().count()).first().text)
    assert blob["aggregate"]["count"] == 2 and [v["video_id"] for v in blob["videos"]] == ["v", "w"]
    log = spark.createDataFrame([("u", "v", "retry")], "url string, video_id string, outcome string")
    for _ in range(2):
        sinks.append_log(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_lines(spark.range(3).withColumn("b", F.col("id") % 2), "id", str(tmp_path / "lines"), "b")
    assert (tmp_path / "lines" / "b=0").exists()


def test_a_report_of_more_than_a_day(spark, tmp_path):
    """Segments of 30 hours: clock times begin again behind 24 hours, as in the query's SQL."""
    import duckdb

    from lectern.plans import file_queries
    from lectern.plans.registry import SQL

    db, home = duckdb.connect(), str(tmp_path)
    tables = {
        "region": "SELECT 0 AS r_regionkey, 'R' AS r_name", "nation": "SELECT i::INT AS n_nationkey, 'N' || i AS n_name, 0 AS n_regionkey FROM range(2) t(i)", "supplier": "SELECT i::BIGINT AS s_suppkey, 1 AS s_nationkey, 'S' || i AS s_name FROM range(8700) t(i)",
        "customer": "SELECT i::BIGINT AS c_custkey, (i % 20 > 0)::INT AS c_nationkey, 'C' || i AS c_name, 'M' AS c_mktsegment FROM range(20000) t(i)",
    }
    for name, sql in tables.items():
        db.execute(f"COPY ({sql}) TO '{home}/{name}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{home}/{name}.parquet'")
    wanted = db.execute(f"SELECT video_id, seq, kind, level, text FROM ({SQL['topics_report']})").fetchall()
    got = file_queries.topics_report(spark, home).select("video_id", "seq", "kind", "level", "text").collect()
    assert any("00:00:04.500]" in r[4] for r in wanted) and sorted(map(tuple, got)) == sorted(wanted)


def test_a_report_of_videos_without_topics(spark, tmp_path):
    """A nation without suppliers and customers has a topics file without topics: its heading is in the report, as in the query's SQL."""
    import duckdb

    from lectern.plans import file_queries
    from lectern.plans.registry import SQL

    for suppliers, customers in ((40, 40), (40, 0), (0, 40), (0, 0)):
        db, home = duckdb.connect(), str(tmp_path / f"{suppliers}-{customers}")
        os.makedirs(home)
        tables = {
            "region": "SELECT 0 AS r_regionkey, 'R' AS r_name", "nation": "SELECT i::INT AS n_nationkey, 'N' || i AS n_name, 0 AS n_regionkey FROM range(8) t(i)", "supplier": f"SELECT i::BIGINT AS s_suppkey, (i % 4)::INT AS s_nationkey, 'S' || i AS s_name FROM range({suppliers}) t(i)",
            "customer": f"SELECT i::BIGINT AS c_custkey, (i % 4)::INT AS c_nationkey, 'C' || i AS c_name, 'M' AS c_mktsegment FROM range({customers}) t(i)",
        }
        for name, sql in tables.items():
            db.execute(f"COPY ({sql}) TO '{home}/{name}.parquet' (FORMAT parquet)")
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{home}/{name}.parquet'")
        wanted = db.execute(f"SELECT video_id, seq, kind, level, text FROM ({SQL['topics_report']})").fetchall()
        got = file_queries.topics_report(spark, home).select("video_id", "seq", "kind", "level", "text").collect()
        assert {r[0] for r in wanted} == {f"v{k}" for k in range(8)} and sorted(map(tuple, got)) == sorted(wanted)


def test_topics_files_are_read_whole(spark, tmp_path):
    """Files without topics, empty or broken ones are rows; an odd topic or a long text takes no topics with it."""
    t = {"title": "a", "description": "d", "start_s": 1.5}
    docs = {
        "good.topics.json": {"video_id": "own", "llm_raw": "text", "topics": [t]}, "no id.json": {"video_id": "", "topics": [t]}, "odd.json": {"topics": [t, "x", None, {**t, "start_s": "soon", "id": 7}]},
        "long.json": {"topics": [{**t, "description": "d" * 20_000_001}]}, "none.json": {"topics": []}, "null.json": {}, "broken.json": None, "empty.json": None,
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc) if doc is not None else '{"topics": [{' if name == "broken.json" else "")
    got = files.topic_documents(spark, str(tmp_path)).collect()
    assert {r.video_id: r.error for r in got} == {"own": None, "no id": None, "odd": None, "long": None, "none": "no topics", "null": "no topics", "broken": "not a topics document", "empty": "not a topics document"}
    rows = files.topics(spark, str(tmp_path)).select("video_id", "topic_id", "title", F.length("description"), "start_s").collect()
    odd = [("odd", "T1", "a", 1, 1.5), ("odd", "T2", "", 0, None), ("odd", "T3", "", 0, None), ("odd", "7", "a", 1, None)]
    assert sorted(map(tuple, rows), key=repr) == sorted([("own", "T1", "a", 1, 1.5), ("no id", "T1", "a", 1, 1.5), ("long", "T1", "a", 20_000_001, 1.5), *odd], key=repr)
    none = report.topics_document(files.topics(spark, str(tmp_path)), *(spark.createDataFrame([], s) for s in ("file string, title string, url string, body string", "video_id string, text string")), files.topic_documents(spark, str(tmp_path)))
    assert {r.video_id for r in none.where("level = 1").collect()} == {r.video_id for r in got}


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """The same rows as Spark's source, which lists all files on the driver and leaves empty ones out."""
    for name in ("a.txt", "b b%20ü.txt", "d/e/f.txt", "d/g.bin", "_hidden/a.txt", ".b.txt", "d/_c.txt", "h/empty.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else name)
    for home in (str(tmp_path), f"file://{tmp_path}/"):
        for glob in ("*", "*.txt"):
            spark_own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(home)
            got = files.contents(spark, home, glob)
            assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
            empty = f"file:{tmp_path}/h/empty.txt"
            assert sorted(got.collect()) == sorted([tuple(r) for r in spark_own.select("path", "length", "content").collect()] + [(empty, 0, b"")])
            assert sorted(files.found(spark, home, glob).collect()) == sorted([tuple(r) for r in spark_own.select("path", "length").collect()] + [(empty, 0)])


@pytest.mark.parametrize("anywhere", [True, False])
def test_a_document_of_metrics_by_many_tasks(spark, tmp_path, monkeypatch, anywhere):
    """Parts of several tasks are one JSON document, which is read in splits."""
    if not anywhere:
        monkeypatch.setattr(committed.fs, "LocalFileSystem", committed.fs.GcsFileSystem)  # as where files only grow
    m = spark.range(0, 3000, 1, 6).select(F.concat(F.lit('v"\n'), F.col("id").cast("string")).alias("video_id"), F.col("id").alias("frames"), F.when(F.col("id") % 2 == 0, 1.5).alias("corr_avg"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for rows, name in ((m, "m.json"), (m.where("frames < 0"), "none.json"), (m.where("frames = 7"), "one.json")):
            path = str(tmp_path / "out" / name)
            sinks.write_metrics(rows, rows.agg(F.count(F.lit(1)).alias("num_videos")), path)
            blob, want = json.loads(open(path).read()), sorted(rows.collect())
            assert blob["aggregate"] == {"num_videos": len(want)}
            assert [(v["video_id"], v["m"]["frames"], v["m"]["corr_avg"]) for v in blob["videos"]] == [tuple(r) for r in want]
            read = files.metrics_document(spark, path, "num_videos:long", "frames:long,corr_avg:double")
            assert sorted((r.video_id, r.m.frames, r.m.corr_avg) for r in read.collect()) == [tuple(r) for r in want]
            assert {r.aggregate.num_videos for r in read.collect()} == ({len(want)} if want else set())
            if name == "m.json":
                assert read.rdd.getNumPartitions() > 3
        assert sorted(os.listdir(tmp_path / "out")) == ["m.json", "none.json", "one.json"]
        (tmp_path / "pretty.json").write_text(json.dumps({"aggregate": {}, "videos": [{"video_id": "v"}]}, indent=1))
        with pytest.raises(Exception, match="not a line for each video"):
            files.metrics_document(spark, str(tmp_path / "pretty.json"), "num_videos:long", "frames:long").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
