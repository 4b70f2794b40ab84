"""Transcripts, topics, results, captions and lists from files."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..functions import urls
from ..session import written
from ..sinks.committed import located
from . import spreadsheet

#: Bytes of contents that are handed on at once.
BLOCK = 4 << 20

#: The longest text in JSON that is read; the parser's own limit is 20,000,000.
MAX_STRING = 2**31 - 1

STEM = r"([^/]+?)(?:\.[^./]+)*$"


def file_stem() -> Column:
    """The file's name up to its last extension."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def sliced(df: DataFrame, order: str, start: int = 0, end: int = -1) -> DataFrame:
    """Rows ``start`` to ``end`` (exclusive; -1: all) in the order of a column of file names.

    The files' listing is small beside their contents; only distinct names are numbered.
    """
    names = df.select(order).distinct().withColumn("_n", F.row_number().over(Window.orderBy(order)) - 1)
    kept = names.where((F.col("_n") >= start) & ((F.lit(end) == -1) | (F.col("_n") < end))).select(order)
    return df.join(kept, order, "left_semi")


def transcripts(spark: SparkSession, path: str, start: int = 0, end: int = -1) -> DataFrame:
    """Transcript documents; the id falls back to the file's stem. A document without segments is an ``error``."""
    df = spark.read.schema(schemas.TRANSCRIPT).json(path, multiLine=True, pathGlobFilter="*.json").withColumn("file", F.col("_metadata.file_name")).withColumn("_stem", file_stem())
    df = df.withColumn("video_id", F.coalesce(F.nullif("video_id", F.lit("")), "_stem")).drop("_stem")
    df = df.withColumn("error", F.when(F.coalesce(F.size("segments"), F.lit(0)) <= 0, F.lit("no segments")))
    return df if (start, end) == (0, -1) else sliced(df, "file", start, end)


def segments(docs: DataFrame) -> DataFrame:
    """``video_id``, ``seg_idx``, ``start``, ``end``, ``text``; the index is the position in the document."""
    return docs.select("video_id", F.posexplode("segments").alias("seg_idx", "s")).select("video_id", "seg_idx", "s.start", "s.end", F.coalesce("s.text", F.lit("")).alias("text"))


def transcript_texts(spark: SparkSession, path: str) -> DataFrame:
    """Plain transcripts: three header lines and the body. An empty file has null fields."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(file_stem().alias("file"), F.regexp_replace("value", "\r\n", "\n").alias("v"))
    every = listing(spark, path, "*.txt", recursive=False).select(F.col("stem").alias("file"))  # a read leaves empty files out
    return every.join(df, "file", "left").select("file", *transcript_fields(F.coalesce("v", F.lit(""))))


def transcript_fields(c: Column) -> list[Column]:
    """``title``, ``url``, ``category`` and ``body`` of a plain transcript's text."""
    ls = F.split(c, "\n")
    head = lambda k: F.when(X.strip(c) != "", X.strip(F.coalesce(F.get(ls, F.lit(k)), F.lit(""))))
    body = X.strip(F.array_join(F.slice(ls, 4, F.greatest(F.size(ls) - 3, F.lit(0))), "\n"))
    return [head(0).alias("title"), head(1).alias("url"), head(2).alias("category"), F.when(X.strip(c) != "", body).alias("body")]


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """SRT cues: ``video_id``, ``seg_idx`` (from 0), ``start``, ``end``, ``text``."""
    from ..functions.times import seconds

    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.srt").select(file_stem().alias("video_id"), F.regexp_replace("value", "\r\n", "\n").alias("v"))
    blocks = df.select("video_id", F.explode(F.split(X.strip(F.col("v")), r"\n\s*\n")).alias("b"))
    part = lambda k: F.regexp_extract("b", r"(?s)^\s*(\d+)\s*\n(\S+) --> (\S+)[^\n]*(?:\n(.*))?$", k)
    return blocks.where(part(1) != "").select("video_id", (part(1).cast("int") - 1).alias("seg_idx"), seconds(part(2)).alias("start"), seconds(part(3)).alias("end"), part(4).alias("text"))


def topic_documents(spark: SparkSession, path: str) -> DataFrame:
    """Topics files, without topics too: ``video_id``, ``topics`` and ``error``; the id falls back to the file's name.

    Each topic is read by itself, so that an odd one takes no other with it. A file that is empty or no such document has null topics and an ``error``.
    """
    shape = "video_id string, topics array<string>, _bad string"
    read = spark.read.schema(shape).option("maxStringLen", MAX_STRING).json(path, multiLine=True, pathGlobFilter="*.json", columnNameOfCorruptRecord="_bad")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    every = listing(spark, path, "*.json", recursive=False).select(plain("path").alias("path"), "name")  # a read leaves empty files out
    docs = every.join(read.select("*", plain("_metadata.file_path").alias("path"), F.lit(True).alias("_read")), "path", "left")
    unread = F.col("topics").isNull() & (F.col("_read").isNull() | F.col("_bad").isNotNull())
    return docs.select(
        F.coalesce(F.nullif("video_id", F.lit("")), F.regexp_replace("name", r"(\.topics)?\.json$", "")).alias("video_id"),
        F.transform("topics", lambda t: F.from_json(t, schemas.TOPIC, {"maxStringLen": str(MAX_STRING)})).alias("topics"),
        F.when(unread, F.lit("not a topics document")).when(F.coalesce(F.size("topics"), F.lit(0)) <= 0, F.lit("no topics")).alias("error"),
    )


def topics(spark: SparkSession, path: str) -> DataFrame:
    """Topics with tolerant fields; a topic without an id is ``T`` and its number among the topics. Files without topics have no row (``topic_documents``)."""
    return topic_rows(topic_documents(spark, path))


def topic_rows(docs: DataFrame) -> DataFrame:
    t = docs.select("video_id", F.posexplode_outer("topics").alias("pos", "t")).where("pos is not null")
    trimmed = lambda c: X.strip(F.coalesce(c, F.lit("")))
    return t.select(
        "video_id", "pos", F.coalesce(F.nullif("t.id", F.lit("")), F.nullif("t.topic_id", F.lit("")), F.concat(F.lit("T"), F.col("pos") + 1)).alias("topic_id"), trimmed("t.title").alias("title"),
        trimmed("t.description").alias("description"), F.coalesce("t.evidence_quotes", F.array().cast("array<string>")).alias("evidence_quotes"), "t.start_s", "t.end_s",
    )


def topics_lookup(videos: DataFrame, listing: DataFrame) -> DataFrame:
    """The topics file of each video: in the topics folder, else in its frames folder with the id in its name, else in a sibling folder.

    ``listing`` has ``path``, ``dir_kind`` ('root', 'frames', 'sibling') and ``stem``.
    """
    rank = F.when(F.col("dir_kind") == "root", 1).when(F.col("dir_kind") == "frames", 2).otherwise(3)
    keyed = listing.withColumn("priority", rank).withColumn("video_id", F.regexp_replace("stem", r"\.topics$", ""))
    inside = keyed.where("dir_kind = 'frames'").withColumn("video_id", urls.dir_id(F.regexp_replace("path", r"/[^/]*$", ""))).where(F.contains("stem", F.col("video_id")))
    found = videos.select("video_id").distinct().join(keyed.where("dir_kind <> 'frames'").unionByName(inside), "video_id")
    return found.groupBy("video_id").agg(F.min_by("path", F.struct("priority", "path")).alias("path"))


def results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Result records of JSON lines: ``file``, ``line`` and the fields. Lines that are blank or no object are left out."""
    raw = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    return result_lines(raw)


def result_lines(raw: DataFrame) -> DataFrame:
    """Parse ``value``; the key of a record is its topic, section, group or frame."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = raw.where(F.trim("value").startswith("{")).withColumn("r", F.from_json("value", schemas.RESULT + ", _bad string", options)).where("r._bad is null and r.video_id is not null")
    return rows.select("file", "line", "r.*").drop("_bad").withColumn("unit_id", F.coalesce("topic_id", "section_id", "group_id", "frame"))


def latest(records: DataFrame) -> DataFrame:
    """The last record of each key, file and video: later lines win."""
    return records.groupBy("file", "video_id", "unit_id").agg(F.max_by(F.struct(*[c for c in records.columns if c not in ("file", "video_id", "unit_id")]), "line").alias("r")).select("file", "video_id", "unit_id", "r.*")


def candidates(records: DataFrame) -> DataFrame:
    """One row per candidate: position, flag, whole score, reason, comment and address."""
    c = records.select(*[x for x in ("file", "line", "video_id", "unit_id", "title") if x in records.columns], F.posexplode("candidates").alias("cand_idx", "c"))
    comment = F.coalesce("c.comment", "c.comment_text", "c.text", "c.body")
    # numbers and booleans count as scores, quoted numbers don't
    kind = F.schema_of_variant("c.score")
    score = F.when(kind == "BOOLEAN", F.try_variant_get("c.score", "$", "boolean").cast("double")).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get("c.score", "$", "double"))
    keep = [x for x in c.columns if x != "c"]
    return c.select(*keep, X.truthy(F.col("c.correlated")).alias("correlated"), score.alias("score"), F.coalesce("c.reason", F.lit("")).alias("reason"), comment.alias("comment"), F.col("c.url").alias("url"))


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """``path``, ``name``, ``stem``, ``ext`` of files, empty ones too; none is opened.

    The names come from the index of files that Spark keeps for any read of the folder.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path).inputFiles()
    df = spark.createDataFrame([(f,) for f in found], "path string")
    name = F.url_decode(F.replace(F.regexp_extract("path", r"([^/]+)$", 1), F.lit("+"), F.lit("%2B")))
    return df.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), urls.extension(name).alias("ext"))


def metrics_document(spark: SparkSession, path: str, aggregate: str, metrics: str) -> DataFrame:
    """A row for each video of a document of ``sinks.files.write_metrics``: ``aggregate``, ``video_id`` and ``m``, with the given fields.

    The document has a line for each video, so that tasks read it in splits. Another layout is an error.
    """
    lines = spark.read.text(path)
    first, video = F.col("value").startswith('{"aggregate": '), F.col("value").startswith('{"video_id":')
    one = lines.where(first).select(F.from_json(F.concat("value", F.lit("]}")), f"aggregate struct<{aggregate}>")["aggregate"].alias("aggregate"))
    known = first | video | F.col("value").isin("]}", "")
    own = F.when(known, F.regexp_replace("value", ",$", "")).otherwise(F.raise_error(F.lit(f"{path}: not a line for each video")))
    rows = lines.where(video | ~known).select(F.from_json(own, f"video_id string, m struct<{metrics}>").alias("v"))
    return rows.join(F.broadcast(one), F.lit(True), "left").select("aggregate", "v.video_id", "v.m")


def found(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path`` and ``length`` of the files below a folder, listed by tasks: the folder itself by one, each folder in it by some other.

    As for Spark's own sources, what begins with ``_`` or a dot is hidden, and files without a match of ``glob`` are left out.
    """
    target, base = located(path)
    before = re.sub("^file:/+", "/", path.rstrip("/")).removesuffix(base) or ("file:" if isinstance(target, fs.LocalFileSystem) else "")

    def look(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            target, _ = located(path)
            for batch in batches:
                todo, rows = batch.column("path").to_pylist(), []
                while todo:
                    for where, length in entries(target, todo.pop().removeprefix(before)):
                        name = where.rsplit("/", 1)[-1]
                        if name[:1] in ("_", "."):
                            continue
                        if length is None and deep:
                            todo.append(where)
                        elif length is None or fnmatch.fnmatchcase(name, glob):
                            rows.append((before + where, length))
                        if len(rows) == 10_000:
                            yield table_of(rows)
                            rows = []
                yield table_of(rows)

        return run

    def table_of(rows: list[tuple[str, int | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in rows], pa.string()), "length": pa.array([n for _, n in rows], pa.int64())})

    shape = "path string, length long"
    top = written(spark.createDataFrame([(base,)], "path string").coalesce(1).mapInArrow(look(False), shape))
    below = top.where("length IS NULL").repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(look(True), shape)
    return top.where("length IS NOT NULL").unionAll(below)


def entries(target: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Paths and lengths of what is in a folder, null for folders; one by one where the file system is a local one."""
    if isinstance(target, fs.LocalFileSystem):
        with os.scandir(folder) as every:
            for e in every:
                yield f"{folder}/{e.name}", None if e.is_dir() else e.stat().st_size
    else:
        for e in target.get_file_info(fs.FileSelector(folder)):
            yield e.path, None if e.type == fs.FileType.Directory else e.size


def contents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path``, ``length`` and ``content`` of the files below a folder, empty ones too, opened where they are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for name in batch.column("path").to_pylist():
                target, where = located(name)
                with target.open_input_stream(where) as f:
                    rows.append((name, f.read()))
                size += len(rows[-1][1])
                if size > BLOCK:
                    yield table_of(rows)
                    rows, size = [], 0
            yield table_of(rows)

    def table_of(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in rows], pa.string()), "length": pa.array([len(c) for _, c in rows], pa.int64()), "content": pa.array([c for _, c in rows], pa.binary())})

    return found(spark, path, glob).repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, length long, content binary")


def correlation_files(files: DataFrame) -> DataFrame:
    """JSON and JSON lines in a video's folder or its raw frames: several globs over one listing, each file once, sorted."""
    return files.where(F.col("name").rlike(r"\.jsonl?$")).select("path").distinct().orderBy("path")


def best_file(rows: DataFrame) -> DataFrame:
    """Per video the file with most records, then most numeric scores, then the smaller name."""
    stats = rows.groupBy("video_id", "file").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"))
    return stats.groupBy("video_id").agg(F.max_by("file", F.struct("n", "n_scored", F.col("file"))).alias("file"))


THUMBS = (".jpg", ".jpeg", ".png")
FRAMES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")


def frames(files: DataFrame, extensions: tuple[str, ...] = FRAMES) -> DataFrame:
    """Frame files under ``raw_frames``: ``video_id`` and ``frame``."""
    return files.where(F.col("ext").isin(*extensions) & F.contains("path", F.lit("/raw_frames/"))).select(urls.dir_id(F.regexp_replace("path", r"/[^/]*$", "")).alias("video_id"), F.col("name").alias("frame"))


def search_terms(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Phrases of a file of lines, without blank ones, from the ``start``-th on."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(X.lines(F.col("value"))).alias("line_no", "phrase"))
    return raw.where(F.col("line_no") >= start)


def external_table(spark: SparkSession, path: str, key: str = "video_id") -> DataFrame:
    """A table to join by video: csv, json or xlsx, all values text. Unknown kinds give an empty table, files that cannot be read an error."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df = spark.read.csv(path, header=True, inferSchema=False)
    elif kind == "json":
        raw = spark.read.text(path, wholetext=True)
        body = F.coalesce(F.from_json(F.get_json_object("value", "$.rows"), "array<map<string,string>>"), F.from_json("value", "array<map<string,string>>"))
        keyed = F.map_values(F.from_json("value", "map<string,map<string,string>>"))
        rows = raw.select(F.posexplode(F.coalesce(body, keyed)).alias("_n", "m"))
        names = rows.where("_n = 0").select(F.explode(F.map_keys("m"))).collect()  # one row's keys
        df = rows.orderBy("_n").select(*[F.col("m")[n[0]].alias(n[0]) for n in names]) if names else None
    elif kind == "xlsx":
        df = spreadsheet.table(spark, path)
    elif kind == "xls":
        raise ValueError(f"{path}: the binary form of spreadsheets is not read; save it as xlsx")
    else:
        df = None
    return spark.createDataFrame([], f"{key} string") if df is None or key not in df.columns else df.withColumn(key, F.col(key).cast("string"))


def raw_comments(spark: SparkSession, path: str) -> DataFrame:
    """Field ``text`` of JSON lines."""
    return spark.read.schema("text string").json(path).select("text")


def video_table(spark: SparkSession, path: str) -> DataFrame:
    """``seq``, ``url``, ``title``, ``category``, ``relevant`` of a CSV with a header."""
    return spark.read.csv(path, header=True, schema="seq int, url string, title string, category string, relevant string")


def metadata(videos: DataFrame, info: DataFrame) -> DataFrame:
    """Address, title and category from the sidecars; made up or defaulted where they are missing."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    category = F.coalesce(F.get("categories", F.lit(0)), blank("category") if "category" in info.columns else F.lit(None).cast("string"))
    i = info.select(F.col("video_id"), F.coalesce(blank("webpage_url"), blank("original_url")).alias("_u"), blank("title").alias("_t"), category.alias("_c"))
    return videos.join(i, "video_id", "left").select("video_id", F.coalesce("_u", F.when(urls.is_id(F.col("video_id")), urls.watch_url(F.col("video_id"))), F.lit("")).alias("url"), F.coalesce("_t", "video_id").alias("title"), F.coalesce("_c", F.lit("Unknown Category")).alias("category"))
