"""A source for what needs a network: search results and metadata replayed from files.

``spark.read.format("replayed_search")`` has a partition for each file of JSON lines (``phrase``, ``page``, ``video_id``,
``title``) in the folder, or file, ``path``, and reads it on an executor; the lines of a phrase are in one file. The driver
only lists names. Options ``target`` (ids kept for each phrase). ``search`` asks page by page instead.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sinks.committed import located


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ReplayedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replayed_search"

    def schema(self) -> str:
        return "phrase string, seq int, video_id string, title string"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.target = options["path"], int(options.get("target", 10))

    def partitions(self) -> list[File]:
        target, base = located(self.path)
        own = target.get_file_info(base)
        found = [own] if own.type == fs.FileType.File else target.get_file_info(fs.FileSelector(base, recursive=True))
        return [File(f.path) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_."]

    def read(self, partition: File):
        """Of each phrase, pages in order, each id once, until the target is met; no more than these are held."""
        target, _ = located(self.path)
        best: dict[str, dict[str, tuple]] = {}
        with target.open_input_file(partition.path) as f:
            for order, line in enumerate(lines(f)):
                row = json.loads(line)
                own = best.setdefault(row["phrase"], {})
                place = (row.get("page", 0), order, (row.get("title") or "").replace(",", ""))
                own[row["video_id"]] = min(own.get(row["video_id"], place), place)
                if len(own) > 4 * self.target + 64:
                    best[row["phrase"]] = dict(sorted(own.items(), key=lambda x: x[1])[: self.target])
        for phrase, own in best.items():
            for seq, (video, (_, _, title)) in enumerate(sorted(own.items(), key=lambda x: x[1])[: self.target]):
                yield phrase, seq, video, title


def lines(f, size: int = 1 << 20):
    """Lines of a file that are not blank, read in blocks."""
    rest = b""
    while block := f.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplayedSearch)
