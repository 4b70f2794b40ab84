"""What a model replied, as columns.

Scoring replies are read from the first, shortest ``{...}``: a nested brace cuts it, and the fallback
takes over, as it does for a score that is null or not a whole number.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import clamp, strip, truthy

SCORE = "struct<correlated:boolean,score:int,reason:string>"
#: The parts of a reply that are tried in turn, and the answer yes with its reason.
SHORTEST, WIDEST, FENCE, YES = r"\{.*?\}", r"\[.*\]", r"^```(?:json)?\s*|\s*```$", r"^yes[:\-]?\s*(.*)"


def score_reply(reply: Column) -> Column:
    """``correlated``, ``score`` (0 to 100) and ``reason`` of a scoring reply."""
    text = F.coalesce(reply, F.lit(""))
    body = F.regexp_extract(text, "(?s)" + SHORTEST, 0)
    read = F.from_json(body, "correlated string, score string, reason string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "false"})
    raw = F.get_json_object(body, "$.score")
    quoted = F.get_json_object(body, "$.score").isNotNull() & body.rlike(r'"score"\s*:\s*"')
    has = body.rlike(r'"score"\s*:')
    number = F.when(~has, F.lit(0)).when(quoted, F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), strip(raw).try_cast("int"))).otherwise(
        # a number is cut to whole, not rounded
        F.when(raw == "true", F.lit(1)).when(raw == "false", F.lit(0)).when(raw.rlike(r"^-?\d"), F.regexp_extract(raw.try_cast("double").cast("decimal(20,4)").cast("string"), r"^-?\d+", 0).try_cast("int"))
    )
    good = (body != "") & read["_bad"].isNull() & number.isNotNull()
    first = F.regexp_extract(text, r"(\d{1,3})", 1)
    parsed = F.struct(truthy(read["correlated"]).alias("correlated"), clamp(number, 0, 100).cast("int").alias("score"), strip(F.coalesce(read["reason"], F.lit(""))).alias("reason"))
    fallback = F.struct(F.contains(F.lower(text), F.lit("yes")).alias("correlated"), clamp(F.coalesce(first.try_cast("int"), F.lit(0)), 0, 100).cast("int").alias("score"), F.substring(text, 1, 400).alias("reason"))
    return F.when(F.coalesce(good, F.lit(False)), parsed).otherwise(fallback)


def sentiment(reply: Column, compat: bool = True) -> Column:
    """``like`` or ``dislike`` by substring.

    As in the published counts, "dislike" contains "like", so it counts as a like; ``compat=False`` looks for it first.
    """
    low = F.lower(reply)
    like, dislike = F.contains(low, F.lit("like")), F.contains(low, F.lit("dislike"))
    return F.when(like, F.lit("like")).when(dislike, F.lit("dislike")) if compat else F.when(dislike, F.lit("dislike")).when(like, F.lit("like"))


def embodied(reply: Column) -> Column:
    """Whether "yes" occurs anywhere, and what follows on the line if the reply begins with it (null if not)."""
    low = F.lower(strip(reply))
    rest = F.regexp_extract(low, YES, 1)
    return F.struct(F.contains(low, F.lit("yes")).alias("is_embodied"), F.when(F.startswith(low, F.lit("yes")), rest).alias("reason"))


# --- lists of topics: JSON with anything around it


def json_array(text: str) -> list | None:
    """The list in a reply: fences off; the widest ``[...]``; else all ``{...}``; else the whole text. None if no way reads."""
    body = re.sub(FENCE, "", (text or "").strip(), flags=re.IGNORECASE)
    tries = []
    if m := re.search(WIDEST, body, re.DOTALL):
        tries.append(m[0])
    if found := re.findall(SHORTEST, body, re.DOTALL):
        tries.append("[" + ",".join(found) + "]")
    for t in [*tries, body]:
        try:
            value = json.loads(t)
        except ValueError:
            continue
        if isinstance(value, list):
            return value
        if isinstance(value, dict) and t is body:
            return [value]
    return None


def clock(text: str) -> float:
    """Seconds of one to three parts; all but the last are whole."""
    parts = str(text).strip().replace(",", ".").split(":")
    if not 1 <= len(parts) <= 3:
        raise ValueError(text)
    total = 0
    for p in parts[:-1]:
        total = total * 60 + int(p)
    return total * 60 + float(parts[-1]) if len(parts) > 1 else float(parts[0])


def quotes_of(item: dict) -> list[str]:
    """At most three quotes; one alone may be a plain text."""
    found = item.get("evidence_quotes") or item.get("quotes") or []
    found = [found] if isinstance(found, str) else found if isinstance(found, list) else []
    return [q.strip() for q in found if isinstance(q, str) and q.strip()][:3]


def words_of(item: dict, *names: str) -> str:
    value = next((item[n] for n in names if item.get(n)), "")
    if not isinstance(value, str):
        raise ValueError(f"{names[0]} is no text")
    return value.strip()


def number_of(item: dict, *names: str) -> float | None:
    for n in names:
        try:
            return float(item[n])
        except (KeyError, TypeError, ValueError):
            continue
    return None


def timed_topic(item: dict) -> dict | None:
    """A topic with times local to its chunk, from a range or from two fields; a malformed range fails the reply."""
    title, description = words_of(item, "title", "topic"), words_of(item, "description", "summary")
    span = words_of(item, "time_range").replace("–", "-")
    if "-" in span:
        start, end = map(clock, span.split("-", 1))
    else:
        start, end = number_of(item, "start_local", "start"), number_of(item, "end_local", "end")
    if title and description and start is not None and end is not None and end > start:
        return {"title": title, "description": description, "evidence_quotes": quotes_of(item), "start_s": start, "end_s": end}
    return None


def whole_topic(item: dict) -> dict | None:
    """A topic of a whole outline with absolute times."""
    title, description = words_of(item, "title"), words_of(item, "description")
    start, end = number_of(item, "start_s"), number_of(item, "end_s")
    if title and description and start is not None and end is not None and end > start:
        return {"title": title, "description": description, "evidence_quotes": quotes_of(item), "start_s": start, "end_s": end}
    return None


def covered_topic(item: dict) -> dict | None:
    """A topic of a whole outline by ranges of line numbers; it has no times."""
    title, description = words_of(item, "title"), words_of(item, "description")
    ranges = []
    for r in item.get("coverage") or [] if isinstance(item.get("coverage"), list) else []:
        try:
            ranges.append({"start_idx": int(r["start_idx"]), "end_idx": int(r["end_idx"])})
        except (KeyError, TypeError, ValueError):
            continue
    if title and description:
        return {"title": title, "description": description, "evidence_quotes": [], "start_s": None, "end_s": None, "coverage": ranges}
    return None


READERS = {"chunk": timed_topic, "whole": whole_topic, "simple": covered_topic}


def topics_of(text: str, mode: str = "chunk") -> tuple[list[dict] | None, str | None]:
    """Valid topics of a reply, or None and why the whole reply fails. An empty list is a success."""
    items = json_array(text)
    if items is None:
        return None, "no JSON array"
    try:
        found = [READERS[mode](item) for item in items if isinstance(item, dict)]
    except ValueError as e:
        return None, str(e)
    out = [{"coverage": None} | t for t in found if t]
    return (sorted(out, key=lambda t: t["start_s"]) if mode == "whole" else out), None


TOPICS = T.StructType([
    T.StructField("topics", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("evidence_quotes", T.ArrayType(T.StringType())), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("coverage", T.ArrayType(T.StructType([T.StructField("start_idx", T.IntegerType()), T.StructField("end_idx", T.IntegerType())])))]))),
    T.StructField("error", T.StringType()),
])


@F.pandas_udf(TOPICS)
def topic_reply(replies: pd.Series) -> pd.DataFrame:
    """Topics of a reply with times local to its chunk, or the error that fails it."""
    found = [topics_of(x) for x in replies]
    return pd.DataFrame({"topics": [t for t, _ in found], "error": [e for _, e in found]})


OUTLINE = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("description", T.StringType())]))


def outline_of(text: str) -> list[dict]:
    """Topics of a Markdown outline: a heading or a bold line opens one, other lines join its description.

    Lines before the first opening belong to no topic.
    """
    out: list[dict] = []
    parts: list[str] = []
    for line in map(str.strip, (text or "").splitlines()):
        bold = re.fullmatch(r"\*\*(.+?)\*\*", line)
        if line.startswith("#") or bold:
            parts = []
            out.append({"title": bold[1].strip() if bold else line.lstrip("# ").strip(), "description": parts})
        elif line:
            parts.append(line.lstrip("*-• ").strip() if line[0] in "*-•" else line)
    return [{"title": t["title"], "description": " ".join(t["description"]).strip()} for t in out if t["title"]]


@F.pandas_udf(OUTLINE)
def markdown_outline(replies: pd.Series) -> pd.Series:
    return pd.Series([outline_of(x) for x in replies])
