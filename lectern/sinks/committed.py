"""A sink of named files that commits: ``df.write.format("named_files").option("path", ...)``.

Columns are a name (text, which may have folders) and a content (binary). Each task attempt writes into a folder of its
own under ``<path>/_staging-<job>``, and its files are moved to their names when all tasks of the job are done.
A task that fails, is killed or runs twice leaves nothing behind, and readers see no half-written file: Spark's file sources skip
names that begin with ``_``. A folder that is not there yet is moved as a whole.

A commit leaves ``<path>/_commits/<job>.json`` with the numbers of files and bytes; committing a job again changes
nothing. Options: ``path``; ``job``, a name of the job, by default random. Mode ``overwrite`` deletes what is
in the folder when the job commits, not before. Two rows of one name in a job fail it in the commit.

That commit is the driver's, a rename for each file or new folder. ``write`` gives the same result for any number of files: names are compared by a
shuffle and files moved by tasks, so the driver sees neither.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


#: Files that a task of ``write`` moves, where there are so many, and bytes that ``join_files`` copies at once.
MOVES, COPY = 20_000, 8 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path.rstrip("/")))


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int
    size: int


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        if [f.dataType.typeName() for f in schema.fields] != ["string", "binary"]:
            raise ValueError("named_files takes a name (string) and a content (binary)")
        return NamedFilesWriter(self.options["path"], self.options.get("job") or uuid.uuid4().hex, overwrite)


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str, overwrite: bool):
        self.path, self.job, self.overwrite = path, job, overwrite

    @property
    def staging(self) -> str:
        return f"_staging-{self.job}"

    def write(self, iterator) -> Attempt:
        """One attempt of a task; what it has written goes if it fails."""
        target, base = located(self.path)
        folder = f"{base}/{self.staging}/{uuid.uuid4().hex}"
        done, made = Attempt(folder, 0, 0), set()
        try:
            for batch in iterator:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    where = place(folder, name)
                    home = where.rsplit("/", 1)[0]
                    if home not in made:
                        target.create_dir(home, recursive=True)
                        made.add(home)
                    if target.get_file_info(where).type != fs.FileType.NotFound:
                        raise ValueError(f"two files of one name: {name}")
                    with target.open_output_stream(where) as f:
                        f.write(data or b"")
                    done.files += 1
                    done.size += len(data or b"")
        except BaseException:
            if made:
                target.delete_dir(folder)
            raise
        return done

    def commit(self, messages: list[Attempt | None]) -> None:
        target, base = located(self.path)
        receipt = f"{base}/_commits/{self.job}.json"
        if target.get_file_info(receipt).type != fs.FileType.NotFound:
            return
        attempts = [m for m in messages if m is not None and m.files]
        twice = clash(target, [m.folder for m in attempts])
        if twice:
            self.abort(messages)
            raise ValueError(f"two files of one name: {twice}")
        target.create_dir(base, recursive=True)
        if self.overwrite:
            for old in target.get_file_info(fs.FileSelector(base)):
                if not old.base_name.startswith("_"):
                    (target.delete_dir if old.type == fs.FileType.Directory else target.delete_file)(old.path)
        for m in attempts:
            move(target, m.folder, base)
        target.create_dir(f"{base}/_commits", recursive=True)
        with target.open_output_stream(receipt) as f:
            f.write(json.dumps({"files": sum(m.files for m in attempts), "bytes": sum(m.size for m in attempts)}).encode())
        self.abort(messages)  # what killed attempts left

    def abort(self, messages: list[Attempt | None]) -> None:
        target, base = located(self.path)
        gone(target, f"{base}/{self.staging}")


def gone(target: fs.FileSystem, folder: str) -> None:
    """Delete a folder if it is there; tasks that are being stopped may still write into it for a moment."""
    for k in range(20):
        if target.get_file_info(folder).type == fs.FileType.NotFound:
            return
        try:
            target.delete_dir(folder)
        except OSError:
            if k == 19:
                raise
            time.sleep(0.25)


def write(rows: DataFrame, path: str, job: str) -> int:
    """Files of ``rows`` (a name, a content) in ``path``, all or none; returns how many.

    A first job writes them into folders of its attempts and notes their names, a second one moves them.
    """
    from ..session import discard, written

    spark = rows.sparkSession
    target, base = located(path)
    staging = f"{base}/_staging-{job}"
    target.create_dir(staging, recursive=True)
    try:
        names = written(rows.mapInArrow(_stager(path, staging), "name string, staged string, size long"))
    except BaseException:
        clear(spark, path, staging)
        raise
    try:
        n, size = names.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        twice = clashes(names).first()
        if twice:
            raise ValueError(f"two files of one name: {twice[0]}")
        tasks = max(spark.sparkContext.defaultParallelism, -(-n // MOVES))
        names.repartition(min(max(n, 1), tasks)).mapInArrow(_mover(path), "n long").agg(F.sum("n")).collect()
        target.create_dir(f"{base}/_commits", recursive=True)
        with target.open_output_stream(f"{base}/_commits/{job}.json") as f:
            f.write(json.dumps({"files": n, "bytes": size}).encode())
    finally:
        discard(names)
        clear(spark, path, staging)
    return n


def clear(spark: SparkSession, path: str, staging: str) -> None:
    """Delete what attempts have left, each folder by a task."""
    target, _ = located(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, _ = located(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                gone(target, folder)
            yield batch

    left = [(f.path,) for f in listed(target, staging)]
    if len(left) > 1:
        spark.createDataFrame(left, "path string").repartition(len(left)).mapInArrow(run, "path string").count()
    gone(target, staging)


def clashes(names: DataFrame) -> DataFrame:
    """Names that two rows have, or that are another name's folder."""
    named = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    folders = names.select(F.regexp_extract("name", "(?s)^(.*)/", 1).alias("d")).where("d <> ''").distinct().select(F.split("d", "/").alias("p"))
    above = folders.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", 1, k), "/"))).alias("name")).distinct()
    return named.where("n > 1").select("name").unionAll(named.join(above, "name", "left_semi").select("name"))


def _stager(path: str, staging: str) -> Callable:
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, _ = located(path)
        folder, made = f"{staging}/{uuid.uuid4().hex}", set()
        try:
            for batch in batches:
                names, staged, sizes = batch.column(0).to_pylist(), [], []
                for name, data in zip(names, batch.column(1)):
                    where, data = place(folder, name), data.as_py() or b""
                    home = where.rsplit("/", 1)[0]
                    if not made:
                        target.create_dir(folder, recursive=False)  # not after the job has been given up
                    if home not in made:
                        target.create_dir(home, recursive=True)
                        made.add(home)
                    with target.open_output_stream(where) as f:
                        f.write(data)
                    staged.append(where)
                    sizes.append(len(data))
                yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "staged": pa.array(staged, pa.string()), "size": pa.array(sizes, pa.int64())})
        except BaseException:
            if made:
                gone(target, folder)
            raise

    return stage


def _mover(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = located(path)
        made = set()
        for batch in batches:
            for name, staged in zip(batch.column("name").to_pylist(), batch.column("staged").to_pylist()):
                where = f"{base}/{name}"
                home = where.rsplit("/", 1)[0]
                if home not in made:
                    target.create_dir(home, recursive=True)
                    made.add(home)
                put(target, staged, where)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return run


def put(target: fs.FileSystem, staged: str, where: str) -> None:
    """Move a file to its name, in the place of a file of that name; nothing is done if an earlier attempt has moved it."""
    try:
        target.move(staged, where)
    except OSError:
        if target.get_file_info(where).type != fs.FileType.File:
            raise
        if target.get_file_info(staged).type != fs.FileType.NotFound:
            target.delete_file(where)
            target.move(staged, where)


def place(folder: str, name: str | None) -> str:
    """Where a file goes; a name must stay in its folder, and its parts may not hide it from readers."""
    parts = (name or "").split("/")
    if any(p in ("", ".", "..") for p in parts) or parts[0].startswith("_"):
        raise ValueError(f"no name of a file: {name!r}")
    return f"{folder}/{name}"


def listed(target: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return target.get_file_info(fs.FileSelector(folder))


def clash(target: fs.FileSystem, folders: list[str]) -> str | None:
    """A name that two attempts have; only folders that both have are looked into."""
    seen: dict[str, list[fs.FileInfo]] = {}
    for f in folders:
        for own in listed(target, f):
            seen.setdefault(own.base_name, []).append(own)
    for name, found in seen.items():
        if len(found) > 1:
            if any(x.type != fs.FileType.Directory for x in found):
                return name
            below = clash(target, [x.path for x in found])
            if below:
                return f"{name}/{below}"
    return None


def move(target: fs.FileSystem, source: str, to: str) -> None:
    """Everything in a folder into another; a folder that is not there is moved whole."""
    for own in listed(target, source):
        where = f"{to}/{own.base_name}"
        there = target.get_file_info(where).type
        if own.type == fs.FileType.Directory and there == fs.FileType.Directory:
            move(target, own.path, where)
        else:
            if there == fs.FileType.File:
                target.delete_file(where)
            target.move(own.path, where)


def join_files(spark: SparkSession, parts: str, path: str, head: bytes, tail: bytes, cut: int) -> None:
    """The files of a folder as one file, in the order of their names, between ``head`` and ``tail``; their last ``cut`` bytes go.

    The file appears when it is whole. Where files can be written anywhere (local and mounted folders), a task for each part copies it to its place;
    elsewhere they only grow, and one task copies them block by block.
    """
    target, base = located(path)
    source, home = located(parts)
    half = "{}/_{}-{}".format(*base.rsplit("/", 1), uuid.uuid4().hex)
    found = sorted((f.path, f.size) for f in listed(source, home) if f.size and f.base_name[0] not in "_.")
    at, rows, rest = len(head), [], max(0, sum(n for _, n in found) - cut)
    for name, n in found:
        rows.append((name, at, min(n, rest)))
        at, rest = at + rows[-1][2], rest - rows[-1][2]
    anywhere = isinstance(target, fs.LocalFileSystem)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, _ = located(parts)
        todo = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        if todo:
            with open(half, "r+b") if anywhere else located(path)[0].open_output_stream(half) as out:
                anywhere or out.write(head)
                for name, at, left in todo:
                    anywhere and out.seek(at)
                    with source.open_input_stream(name) as f:
                        while left:
                            block = f.read(min(left, COPY))
                            if not block:
                                raise EOFError(name)
                            out.write(block)
                            left -= len(block)
                anywhere or out.write(tail)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(todo)], pa.int64())})

    target.create_dir(base.rsplit("/", 1)[0], recursive=True)
    if anywhere or not rows:
        with target.open_output_stream(half) as f:
            f.write(head + (b"" if rows else tail))
    if rows:
        dealt = spark.createDataFrame(rows, "name string, at long, n long")
        (dealt.repartition(len(rows), "at") if anywhere else dealt.coalesce(1)).mapInArrow(run, "n long").agg(F.sum("n")).collect()
        if anywhere:
            with target.open_append_stream(half) as f:
                f.write(tail)
    target.move(half, base)


def receipt(path: str, job: str) -> dict:
    """Files and bytes of a committed job."""
    target, base = located(path)
    with target.open_input_stream(f"{base}/_commits/{job}.json") as f:
        return json.loads(f.read())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)
