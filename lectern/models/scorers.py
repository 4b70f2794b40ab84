"""Scorers, embedders and completions.

A backend is a picklable object with one method; it runs in Python workers over Arrow batches, after
retrieval and never before it. ``ReplayScorer`` gives recorded results; ``lexical_score`` is an
expression and stays in the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import replies, vectors
from ..functions import text as X
from ..session import written
from .ledger import Ledger, call, said


class Completion(Protocol):
    """Text, and for image models bytes, to text."""

    def complete(self, prompt: str, image: bytes | None = None) -> str: ...


class Scripted:
    """A completion that answers from a table of prompts' fingerprints; for tests and replays."""

    def __init__(self, answers: dict[str, str], default: str = ""):
        self.answers, self.default = answers, default

    def complete(self, prompt: str, image: bytes | None = None) -> str:
        return self.answers.get(hashlib.md5(prompt.encode()).hexdigest()[:10], self.default)


def lexical_score(a: Column, b: Column) -> Column:
    """floor(100 x Jaccard of the word sets)."""
    return F.floor(100 * vectors.jaccard(X.word_set(a), X.word_set(b))).cast("int")


def score_lexically(pairs: DataFrame, unit_text: str, comment: str, min_score: int = 60) -> DataFrame:
    s = lexical_score(F.col(unit_text), F.col(comment))
    return pairs.withColumn("score", s).withColumn("correlated", F.col("score") >= min_score).withColumn("reason", F.lit("word overlap"))


def score_by_replay(pairs: DataFrame, recorded: DataFrame, keys: tuple[str, ...] = ("video_id", "unit_id", "comment")) -> DataFrame:
    """Recorded scores of the pairs; pairs without a record are left out."""
    return pairs.join(recorded.select(*keys, "correlated", "score", "reason"), list(keys))


def score_by_model(pairs: DataFrame, model: Completion, prompt: Column, tries: int = 1, ledger: Ledger | None = None) -> DataFrame:
    """Ask a model for each pair and read its reply. The prompt is a column, so that it is built in the JVM."""
    asked = complete(pairs.withColumn("_prompt", prompt), model, "_prompt", "_reply", tries, ledger=ledger)
    r = replies.score_reply(F.col("_reply"))
    return asked.withColumn("_r", r).select(*pairs.columns, "_r.correlated", "_r.score", "_r.reason")


def complete(rows: DataFrame, model: Completion, prompt: str, out: str, tries: int = 3, image: str | None = None, ledger: Ledger | None = None) -> DataFrame:
    """Add a model's text. A call that fails ``tries`` times gives an error mark, never an exception.

    With a ledger each call is made once, now, and joined from there; without one it is part of the plan and made whenever that runs.
    """
    if ledger is not None:
        return ledger.ask(rows, model, prompt, "_calls", label=f"complete {name_of(model)}", tries=tries, image=image).withColumn(out, said(F.col("_calls"))).drop("_calls")
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # columns stay as they came; only prompts and images of a few rows at a time become Python objects
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                images = part.column(image).to_pylist() if image else [None] * part.num_rows
                said = [_ask(model, p, i, tries) for p, i in zip(part.column(prompt).to_pylist(), images)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string())], names=names)

    return rows.mapInArrow(run, schema)


def name_of(model: Completion) -> str:
    """What tells a model's calls from another's: its ``name``, else its class and plain settings."""
    plain = {k: v for k, v in getattr(model, "__dict__", {}).items() if isinstance(v, str | int | float | tuple)}
    return getattr(model, "name", f"{type(model).__qualname__} {sorted(plain.items())}")


def _ask(model: Completion, prompt: str, image: bytes | None, tries: int) -> str:
    error = ""
    for _ in range(max(1, tries)):
        reply, error = call(model, prompt, image)
        if reply is not None:
            return reply
    return error


def embed(rows: DataFrame, text: str, out: str = "embedding", dims: int = 64) -> DataFrame:
    """Unit vectors of hashed words; the stand-in for a sentence model, of which no weights are at hand.

    Words are cut by built-in functions; the distinct words of a batch are hashed (32 bits of MD5: the top one is the
    sign, the rest the dimension), and counting them up is one array operation.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({X.WORD})"), 1)

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            size = lists.value_lengths().fill_null(0).to_numpy()
            coded = lists.flatten().dictionary_encode()
            known = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in coded.dictionary.to_pylist()], np.int64)
            h = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(size)), size)
            v = np.bincount(row * dims + h % dims, np.where(h >> 31 == 1, 1.0, -1.0), len(size) * dims).reshape(-1, dims)
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            flat = pa.array((v / np.where(norm > 0, norm, 1)).astype(np.float32).ravel())
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * dims, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=schema.fieldNames())

    return rows.withColumn("_words", words).mapInArrow(run, schema)


# --- extraction of topics


STRICT = "\nThe whole answer must be one JSON array: it starts with [ and ends with ]."
HINT = "\nAnswer with a JSON array and nothing else."

EXTRACTED = T.StructType([T.StructField("parsed", replies.TOPICS["topics"].dataType), T.StructField("attempts", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def phrase(prompt: str, attempt: int, tries: int) -> str:
    """The second try on with a hint, the last one with the strict suffix."""
    return prompt + (STRICT if attempt == tries - 1 else HINT if attempt else "")


def extract_with_retries(rows: DataFrame, model: Completion, prompt: str, tries: int = 3, mode: str = "chunk", ledger: Ledger | None = None) -> DataFrame:
    """Ask for topics until a reply reads: the second try on with a hint, the last one with the strict suffix.

    Adds ``extracted``: topics or null, all attempts, and the error. Attempts stay with a failure. With a ledger
    each prompt and try is asked once, and what is read from the replies can be read again.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("extracted", EXTRACTED)])
    tries = max(1, tries)
    reads = lambda reply: replies.topics_of(reply, mode)[0] is not None
    recorded = ledger is not None
    if recorded:
        asked = ledger.ask(rows, model, prompt, "_calls", label=f"topics {mode} {name_of(model)}", tries=tries, phrase=phrase, accept=reads)
        rows = asked.withColumn("_attempts", F.transform("_calls", lambda x: F.coalesce(x["reply"], x["error"]))).drop("_calls")

    def ask(p: str) -> dict:
        attempts = []
        for k in range(tries):
            attempts.append(_ask(model, phrase(p, k, tries), None, 1))
            topics, error = replies.topics_of(attempts[-1], mode)  # read once, for the decision and the result
            if topics is not None:
                break
        return {"parsed": topics, "attempts": attempts, "error": error if topics is None else None}

    def one(attempts: list[str]) -> dict:
        topics, error = replies.topics_of(attempts[-1], mode)
        return {"parsed": topics, "attempts": attempts, "error": error if topics is None else None}

    kind = to_arrow_type(EXTRACTED)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [one(a) for a in part.column("_attempts").to_pylist()] if recorded else [ask(p) for p in part.column(prompt).to_pylist()]
                kept = [part.column(c) for c in names[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, kind)], names=names)

    return rows.mapInArrow(run, schema)


def cascade(units: DataFrame, *stages) -> DataFrame:
    """The first stage that gives topics wins: each runs on what the ones before left without any.

    A stage is (name, function from units to units with ``topics``). What a stage gives is written before it is used
    twice, so a stage runs once.
    """
    rest, out = units, None
    for name, stage in stages:
        got = written(stage(rest).where(F.size("topics") > 0).withColumn("mode", F.lit(name)))
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
        rest = rest.join(got.select("video_id"), "video_id", "left_anti")
    return out
