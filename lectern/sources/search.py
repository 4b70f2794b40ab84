"""Paged search as a source, in batches and as a stream: pages are asked for on executors, within a quota.

Phrases are cut into slices, which ``prepare`` writes as files; a partition is a page of one slice, so the driver sees no
phrase and no result. The offset of the stream counts (page, slice) in page order: first the first page of
all phrases, then the second. A micro-batch admits as many slices as ``quota`` calls allow; with the trigger
``availableNow`` a run uses up one quota and the next run goes on there.

A page's token is in the page before it, so what was received is kept in the folder ``cache``, by phrase and page: a batch that runs
again, or a task tried twice, reads what is there and spends no call. Each id of a phrase counts once, and a phrase
that has its ``target``, or no further page, asks no more.

Options: ``phrases`` (the folder of slices), ``n_slices``, ``slice`` (phrases in one), ``cache``, ``target`` (10), ``pages`` (10), ``quota`` (calls of a
micro-batch, by default all). ``RecordedSearch`` (``recorded_search``) answers from recorded pages in the folder ``path``;
a real search is a ``PagedSearch`` with a backend of its own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.acquisition import number_rows
from ..sinks.committed import located
from ..sinks.files import write_named

FIRST = "first"


class Backend(Protocol):
    """A page of results: ``items`` (``video_id``, ``title``) and ``next``, the token of the page behind it or None."""

    def page(self, phrase: str, token: str | None) -> dict: ...


class Slice(InputPartition):
    def __init__(self, number: int, pages: tuple[int, ...]):
        self.number, self.pages = number, pages


class Pages:
    """Reads pages of phrases, from the cache or, once, from the backend."""

    def __init__(self, options: dict, backend: Backend):
        self.phrases, self.cache, self.backend = options["phrases"], options["cache"], backend
        self.target, self.pages, self.n_slices = int(options.get("target", 10)), int(options.get("pages", 10)), int(options["n_slices"])
        self.admitted = max(1, int(options["quota"]) // int(options["slice"])) if "quota" in options else self.n_slices * self.pages

    def rows(self, part: Slice):
        """(phrase, seq, video_id, title) of what the pages of a slice add."""
        target, base = located(self.phrases)
        with target.open_input_stream(f"{base}/{part.number}.json") as f:
            phrases = json.loads(f.read())
        for page in part.pages:
            for phrase in phrases:
                yield from self.added(phrase, page)

    def added(self, phrase: str, page: int):
        seen, last = set(), {"next": FIRST}
        for k in range(page):
            last = self.kept(phrase, k)
            if last is None:
                return
            seen.update(x["video_id"] for x in last["items"])
        if len(seen) >= self.target or last["next"] is None:
            return
        now = self.kept(phrase, page)
        if now is None:
            now = self.keep(phrase, page, self.backend.page(phrase, None if page == 0 else last["next"]))
        for item in now["items"]:
            if item["video_id"] not in seen and len(seen) < self.target:
                seen.add(item["video_id"])
                yield phrase, len(seen) - 1, item["video_id"], (item.get("title") or "").replace(",", "")

    def place(self, phrase: str, page: int) -> tuple[fs.FileSystem, str]:
        target, base = located(self.cache)
        return target, f"{base}/{name_of(phrase)}/{page}.json"

    def kept(self, phrase: str, page: int) -> dict | None:
        target, where = self.place(phrase, page)
        if target.get_file_info(where).type == fs.FileType.NotFound:
            return None
        with target.open_input_stream(where) as f:
            return json.loads(f.read())

    def keep(self, phrase: str, page: int, got: dict) -> dict:
        """Written under another name first, so that a page in the cache is whole."""
        target, where = self.place(phrase, page)
        target.create_dir(where.rsplit("/", 1)[0], recursive=True)
        draft = f"{where}.{uuid.uuid4().hex}"
        with target.open_output_stream(draft) as f:
            f.write(json.dumps(got).encode())
        target.move(draft, where)
        return got


def name_of(phrase: str) -> str:
    return hashlib.md5(phrase.encode()).hexdigest()


class SearchBatch(DataSourceReader):
    """All pages of a slice in one partition."""

    def __init__(self, pages: Pages):
        self.pages = pages

    def partitions(self) -> list[Slice]:
        return [Slice(k, tuple(range(self.pages.pages))) for k in range(self.pages.n_slices)]

    def read(self, partition: Slice):
        return self.pages.rows(partition)


class SearchStream(DataSourceStreamReader):
    def __init__(self, pages: Pages):
        self.pages, self.at = pages, 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        """As far as the quota goes from what was planned last."""
        return {"at": min(self.at + self.pages.admitted, self.pages.n_slices * self.pages.pages)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        """Spark names the last offset, start and end alike, when a query goes on."""
        self.at = end["at"]
        return [Slice(k % self.pages.n_slices, (k // self.pages.n_slices,)) for k in range(start["at"], end["at"])]

    def read(self, partition: Slice):
        return self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedSearch(DataSource):
    """A search by pages; subclasses give ``name`` and ``backend``."""

    def schema(self) -> str:
        return "phrase string, seq int, video_id string, title string"

    def backend(self) -> Backend:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return SearchBatch(Pages(dict(self.options), self.backend()))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SearchStream(Pages(dict(self.options), self.backend()))


class Recorded:
    """Pages recorded as ``<path>/<md5 of the phrase>/<token>.json``, the first as ``first``; others are empty."""

    def __init__(self, path: str):
        self.path = path

    def page(self, phrase: str, token: str | None) -> dict:
        target, base = located(self.path)
        where = f"{base}/{name_of(phrase)}/{token or FIRST}.json"
        if target.get_file_info(where).type == fs.FileType.NotFound:
            return {"items": [], "next": None}
        with target.open_input_stream(where) as f:
            return json.loads(f.read())


class RecordedSearch(PagedSearch):
    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def backend(self) -> Backend:
        return Recorded(self.options["path"])


def prepare(phrases: DataFrame, path: str, size: int = 100, phrase: str = "phrase") -> dict[str, str]:
    """Write the distinct phrases in slices, in order; gives the options that a search needs of them."""
    numbered = number_rows(phrases.select(phrase).where(F.col(phrase).isNotNull()).distinct(), phrase)
    slices = numbered.groupBy(F.floor((F.col("rn") - 1) / size).alias("k")).agg(F.to_json(F.sort_array(F.collect_list(phrase))).alias("text"))
    n = write_named(slices.select(F.concat(F.col("k").cast("string"), F.lit(".json")).alias("name"), "text"), path)
    return {"phrases": path, "n_slices": str(n), "slice": str(size)}


def record(results: DataFrame, path: str, page_size: int = 50) -> int:
    """Recorded pages of results (``phrase``, ``position``, ``video_id``, ``title``): so many in each, tokens between them."""
    from pyspark.sql import Window

    at = results.withColumn("k", F.row_number().over(Window.partitionBy("phrase").orderBy("position", "video_id")) - 1).withColumn("page", F.floor(F.col("k") / page_size))
    pages = at.groupBy("phrase", "page").agg(F.sort_array(F.collect_list(F.struct("k", "video_id", "title"))).alias("items"))
    token = lambda page: F.when(page == 0, FIRST).otherwise(F.concat(F.lit("t"), page.cast("string")))
    more = F.lead("page").over(Window.partitionBy("phrase").orderBy("page")).isNotNull()
    body = F.struct(F.transform("items", lambda x: x.dropFields("k")).alias("items"), F.when(more, token(F.col("page") + 1)).alias("next"))
    name = F.concat(F.md5(F.col("phrase").cast("binary")), F.lit("/"), token(F.col("page")), F.lit(".json"))
    return write_named(pages.select(name.alias("name"), F.to_json(body, {"ignoreNullFields": "false"}).alias("text")), path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedSearch)
