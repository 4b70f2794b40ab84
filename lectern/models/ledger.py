"""A ledger of model calls: each call is written once under the fingerprint of what was asked, and joined from there.

A call to a model costs money and may answer otherwise the second time, so it must not be part of a plan that
runs again whenever its result is used. ``Ledger.ask`` asks for what the ledger lacks, appends the answers as
Parquet, and joins them to the rows. Equal prompts are asked once. A run that stopped goes on with what it had not written.

Each task commits what it has asked as a file of its own, which appears under its name when it is whole. A file holds at most
``task_calls`` prompts, and fewer where the tasks would have over ``commit_calls`` between them that are asked but not written: so many are asked
again at most if the driver, or a task, is lost in the middle, whatever the cluster's size. A task that runs again goes on behind its files.
Where an ask made many files, they are written once more in few, which are read instead; nothing is deleted that another run may read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, exists, folders, work_dir, written
from ..sinks.committed import located

CALLS = "key string, label string, try int, reply string, error string, accepted boolean, run string"
STORED = pa.schema([("key", pa.string()), ("label", pa.string()), ("try", pa.int32()), ("reply", pa.string()), ("error", pa.string()), ("accepted", pa.bool_()), ("run", pa.string())])
#: The name of a folder of files that tasks commit, and what is added to it for the same calls in few files.
COMMITS, FEW = "calls-", ".few"
#: So many files of an ask are left as they are, and so many calls make one of the few.
MANY, A_FILE = 1_000, 250_000


def fingerprint(label: str, prompt: Column, image: Column | None = None) -> Column:
    """SHA-256 of the label, the prompt and the digest of the image. A null prompt is the empty text."""
    return F.sha2(F.concat_ws("\n", F.lit(label), F.lit("-") if image is None else F.coalesce(F.sha2(image, 256), F.lit("-")), F.coalesce(prompt, F.lit(""))), 256)


def as_asked(prompt: str, attempt: int, tries: int) -> str:
    """The prompt itself, whatever the try."""
    return prompt


class Ledger:
    """Calls in a folder that all executors and later runs share; without ``path`` a work folder of this session."""

    def __init__(self, spark: SparkSession, path: str | None = None, commit_calls: int = 100_000, task_calls: int = 500):
        self.spark, self.path = spark, path or work_dir(spark)
        self.commit_calls, self.task_calls, self.run = commit_calls, task_calls, uuid.uuid4().hex

    def calls(self) -> DataFrame:
        """Every call: ``key``, ``label``, ``try`` from 0, ``reply`` or ``error``, whether it was accepted, and the run that made it."""
        found = folders(self.spark, self.path)
        whole = {d for d in found if not d.rsplit("/", 1)[1].startswith(COMMITS) or d.endswith(FEW)}
        whole = {d for d in whole if exists(self.spark, f"{d}/_SUCCESS")}
        done = [d for d in found if d in whole or (d.rsplit("/", 1)[1].startswith(COMMITS) and not d.endswith(FEW) and d + FEW not in whole)]
        # folders are named one by one: scans of one path count as equal to Spark whenever it was listed
        return self.spark.read.schema(CALLS).option("recursiveFileLookup", "true").parquet(*done) if done else self.spark.createDataFrame([], CALLS)

    def answers(self) -> DataFrame:
        """``key``, ``tries`` made, ``done`` (one was accepted) and ``attempts`` in order: what was said, or the error."""
        once = self.calls().groupBy("key", "try").agg(F.min_by(F.struct("reply", "error", "accepted"), "run").alias("c"))  # of two runs at once the same one counts for all
        return once.groupBy("key").agg(
            F.count(F.lit(1)).alias("tries"), F.bool_or("c.accepted").alias("done"), F.transform(F.sort_array(F.collect_list(F.struct("try", "c"))), lambda x: F.struct(x["c"]["reply"].alias("reply"), x["c"]["error"].alias("error"), x["c"]["accepted"].alias("accepted"))).alias("attempts")
        )

    def ask(
        self, rows: DataFrame, model, prompt: str, out: str = "calls", *, label: str = "", tries: int = 1, image: str | None = None,
        phrase: Callable[[str, int, int], str] = as_asked, accept: Callable[[str], bool] = bool,
    ) -> DataFrame:
        """``rows`` with ``out``, the attempts in order, each with ``reply``, ``error`` and ``accepted``.

        A prompt is asked until a reply is accepted, ``tries`` times at most; ``phrase`` gives its text for a try. ``label`` names
        model and purpose: what is asked under another label is another call. An exception of the model is an error, never a failed job.
        """
        key = fingerprint(f"{label}\n{tries}", F.col(prompt), None if image is None else F.col(image))
        keyed = rows.withColumn("_key", key)
        wanted = keyed.groupBy(F.col("_key").alias("key")).agg(F.coalesce(F.first(prompt), F.lit("")).alias("prompt"), (F.first(image) if image else F.lit(None).cast("binary")).alias("image"))
        known = self.answers().select("key", "tries", "done")
        wanted = wanted.join(known, "key", "left").where(f"not coalesce(done, false) and coalesce(tries, 0) < {tries}")
        todo = written(wanted.select("key", "prompt", "image", F.coalesce("tries", F.lit(0)).cast("int").alias("made")))
        n = todo.count()
        if n:
            parts = -(-n // self.task_calls)
            tasks = max(1, min(parts, self.commit_calls, self.spark.sparkContext.defaultParallelism))
            each = max(1, min(self.task_calls, self.commit_calls // tasks))
            folder = f"{self.path}/{COMMITS}{uuid.uuid4().hex}"
            dealt = todo.repartition(parts, "key").withColumn("part", F.expr(f"pmod(hash(key), {parts})"))
            # a task takes its parts one after another, so that a batch holds one part's prompts at most
            made = dealt.mapInPandas(_asker(model, label, tries, phrase, accept, self.run, folder, each), "files long, calls long").coalesce(tasks)
            n_files, n_calls = made.agg(F.coalesce(F.sum("files"), F.lit(0)), F.coalesce(F.sum("calls"), F.lit(0))).first()
            if n_files > MANY:
                self.spark.read.schema(CALLS).option("recursiveFileLookup", "true").parquet(folder).coalesce(-(-n_calls // A_FILE)).write.parquet(folder + FEW)
        discard(todo)
        return keyed.join(self.answers().select(F.col("key").alias("_key"), F.col("attempts").alias(out)), "_key").drop("_key")


def _asker(model, label: str, tries: int, phrase, accept, run: str, folder: str, each: int):
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, home = located(folder)
        out, asked, done, n_files, n_calls = [], 0, None, 0, 0

        def commit() -> None:
            nonlocal out, asked, n_files, n_calls
            name, own = f"{uuid.uuid4().hex}.parquet", f"{home}/{part}"
            target.create_dir(own, recursive=True)
            pq.write_table(pa.Table.from_pylist([dict(zip(STORED.names, row)) for row in out], STORED), f"{own}/_{name}", filesystem=target)
            target.move(f"{own}/_{name}", f"{own}/{name}")
            out, asked, n_files, n_calls = [], 0, n_files + 1, n_calls + len(out)

        for df in frames:
            for key, prompt, image, made, part in zip(df["key"], df["prompt"], df["image"], df["made"], df["part"]):
                if done is None:
                    done, n_files, n_calls = kept(target, f"{home}/{part}")
                if key in done:
                    continue
                for k in range(made, tries):
                    reply, error = call(model, phrase(prompt, k, tries), image)
                    good = reply is not None and bool(accept(reply))
                    out.append((key, label, k, reply, error, good, run))
                    if good:
                        break
                asked += 1
                if asked == each:
                    commit()
        if out:
            commit()
        yield pd.DataFrame({"files": [n_files], "calls": [n_calls]})

    return ask


def kept(target: fs.FileSystem, home: str) -> tuple[set[str], int, int]:
    """The keys that an earlier attempt has committed of a part, and the numbers of its files and calls."""
    found = target.get_file_info(fs.FileSelector(home, allow_not_found=True))
    tables = [pq.read_table(f.path, columns=["key"], filesystem=target) for f in found if not f.base_name.startswith("_")]
    return {k for t in tables for k in t.column("key").to_pylist()}, len(tables), sum(t.num_rows for t in tables)


def call(model, prompt: str, image: bytes | None) -> tuple[str | None, str | None]:
    """What a model says, or why it says nothing."""
    try:
        reply = model.complete(prompt, image)
    except Exception as e:  # noqa: BLE001 - any failure of a model is a reply
        return None, f"[Error: {e}]"
    return (reply, None) if reply else (None, "[No content received]")


def said(calls: Column) -> Column:
    """The accepted reply of ``ask``'s attempts, else the last one's reply or error."""
    last = F.element_at(calls, -1)
    return F.coalesce(last["reply"], last["error"])
