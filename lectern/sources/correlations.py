"""Scored records of whole JSON documents and of older shapes, as (``file``, ``comment``, ``score``) rows.

Line files are read by ``sources.files.results``. Documents are nested in ways that no one schema
describes, so each is walked where it is read; one that is no JSON has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which records, and the text of a comment, may be found.
CONTAINERS = ("candidates", "correlations", "results", "items", "data")
TEXTS = ("comment", "comment_text", "text", "body")


def record(item: dict) -> tuple[str | None, float | None]:
    """The comment (the first text that is not blank) and the score (numbers and booleans only)."""
    comment = next((item[k].strip() for k in TEXTS if isinstance(item.get(k), str) and item[k].strip()), None)
    score = item.get("score")
    return comment, float(score) if isinstance(score, (int, float)) else None


def candidates_of(value: Any) -> Iterator[dict]:
    """Candidates of a document that is one unit or a list of units; other shapes have none."""
    for unit in value if isinstance(value, list) else [value]:
        if isinstance(unit, dict):
            yield from (c for c in unit.get("candidates") or [] if isinstance(c, dict))


def leaves(value: Any) -> Iterator[dict]:
    """Records of older shapes: in a container, or by themselves, in lists of any depth."""
    if isinstance(value, list):
        for item in value:
            yield from leaves(item)
    elif isinstance(value, dict):
        held = next((value[k] for k in CONTAINERS if isinstance(value.get(k), list)), None)
        for item in [value] if held is None else held:
            if not isinstance(item, dict):
                continue
            if isinstance(item.get("candidates"), list):
                yield from (c for c in item["candidates"] if isinstance(c, dict))
                continue
            yield item
            yield from (m for m in item.get("matches") or [] if isinstance(item.get("matches"), list) and isinstance(m, dict))


def documents(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """Records of all ``*.json`` under a path; with ``legacy`` those of older shapes too."""
    walk = leaves if legacy else candidates_of
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"file": [], "comment": [], "score": []}
            for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                try:
                    value = json.loads(text)
                except ValueError:
                    continue
                for item in walk(value):
                    comment, score = record(item)
                    out["file"].append(file)
                    out["comment"].append(comment)
                    out["score"].append(score)
            yield pa.RecordBatch.from_arrays([pa.array(out["file"], pa.string()), pa.array(out["comment"], pa.string()), pa.array(out["score"], pa.float64())], names=list(out))

    return raw.mapInArrow(run, "file string, comment string, score double")
