"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string; nothing is known of its inside.
Rendering the first k turns for k = 1, 2, ... and comparing consecutive outputs locates each turn: if
output k begins with output k - 1, the rest is the turn's span. If it does not, the template rewrites
history at turn k, which is reported, and the common prefix bounds what it left alone. Inside a span,
rendering the turn twice more with two one-letter texts that differ gives the place of the text: the
first position where the two differ is its start, and what follows the letter is the turn's tail.

``TEMPLATE`` marks turns by control strings and escapes the characters these are made of, reversibly,
so no text can contain a control string. ``read_back`` parses its output.

Edge cases: a null text or role counts as empty; rows of one turn number are ordered by role and text
and all kept; a null conversation id is a conversation; repeated rows are turns of their own; a conversation
is one row in one task, and as a black box is rendered three times for each prefix, its cost grows with the square of
its length (5,000 turns of 1 MB: README); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import bound_batches, map_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "[": "\\o", "]": "\\c"}
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_PLAIN = {v[1]: k for k, v in ESCAPES.items()}
_TURN = re.compile(r"\[INST\] (?P<user>[^\[<]*) \[/INST\]|<<(?P<role>[^<>]*)>>(?P<other>[^<]*)<</>>|(?P<assistant>[^\[<]*)</s>")


def escape(text: str) -> str:
    """``text`` without the characters of control strings."""
    for plain, marked in ESCAPES.items():  # the backslash first
        text = text.replace(plain, marked)
    return text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _PLAIN[m[1]], text)


def _marked(turn: Turn) -> str:
    role, text = turn
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]"
    if role == "assistant":
        return f"{body}</s>"
    return f"<<{escape(role)}>>{body}<</>>"


class _Marked(dict):
    """Turns as marked, each once; a conversation's turns are rendered again for every prefix."""

    def __missing__(self, turn: Turn) -> str:
        self[turn] = out = _marked(turn)
        return out


def template(turns: list[Turn], marked: dict[Turn, str] | None = None) -> str:
    """Users between [INST] and [/INST], the assistant up to </s>, all other roles named in << >>."""
    marked = _Marked() if marked is None else marked
    return "".join([marked[t] for t in turns])


#: A template may have ``of_conversation``, which gives it anew with a memory for one conversation.
template.of_conversation = lambda: partial(template, marked=_Marked())


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of ``template``."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        if m["user"] is not None:
            out.append(("user", unescape(m["user"])))
        elif m["assistant"] is not None:
            out.append(("assistant", unescape(m["assistant"])))
        else:
            out.append((unescape(m["role"]), unescape(m["other"])))
    return out


@dataclass
class Rendered:
    """An output, the span of each turn, the span of each turn's text, and the turns that rewrote history."""

    formatted: str
    turns: list[tuple[int, int]] = field(default_factory=list)
    texts: list[tuple[int, int] | None] = field(default_factory=list)
    rewrites: list[int] = field(default_factory=list)


def common(a: str, b: str, known: int = 0) -> int:
    """Length of the common prefix, by bisection over slices; the first ``known`` characters are equal."""
    low, high, size = known, min(len(a), len(b)), 64
    while low < high and a[low : low + size] == b[low : low + size]:
        low, size = low + size, size * 2
    low, high = min(low, high), min(high, low + size)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def render(turns: list[Turn], make: Template = template) -> Rendered:
    """Render successive prefixes and locate every turn and its text."""
    make = getattr(make, "of_conversation", lambda: make)()
    out = Rendered("")
    last = ""
    for k, (role, _) in enumerate(turns):
        now = make(turns[: k + 1])
        begin = len(last) if now.startswith(last) else common(last, now)
        if begin < len(last):
            out.rewrites.append(k)
            out.turns = [(min(a, begin), min(b, begin)) for a, b in out.turns]
            out.texts = [t if t and t[1] <= begin else None for t in out.texts]
        x, y = (make([*turns[:k], (role, c)]) for c in "xy")
        known = begin if x[:begin] == y[:begin] else 0
        start = common(x, y, known)
        tail = x[start + 1 :]
        good = start < len(x) and y[start + 1 :] == tail and now.startswith(x[:start]) and now.endswith(tail) and start + len(tail) <= len(now)
        out.turns.append((begin, len(now)))
        out.texts.append((start, len(now) - len(tail)) if good and start >= begin else None)
        last = now
    out.formatted = last
    return out


def format_conversations(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", make: Template = template, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``formatted``, ``turn_spans``, ``loss_spans`` and ``rewrites``.

    ``loss_spans`` are the spans of the texts of the roles in ``learn``; a text that rewriting makes
    impossible to locate has none, and its turn is in ``rewrites``.
    """
    bound_batches(rows.sparkSession)
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    span = T.ArrayType(T.ArrayType(T.LongType()))
    schema = T.StructType([grouped.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("turn_spans", span), T.StructField("loss_spans", span), T.StructField("rewrites", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in schema.fieldNames()[1:]}
        for own in batch.column("turns").to_pylist():
            turns = [(t["role"], t["text"]) for t in own]
            r = render(turns, make)
            out["n_turns"].append(len(turns))
            out["formatted"].append(r.formatted)
            out["turn_spans"].append([list(s) for s in r.turns])
            out["loss_spans"].append([list(s) for (who, _), s in zip(turns, r.texts) if who in learn and s])
            out["rewrites"].append(r.rewrites)
        return {"conv_id": batch.column("conv_id")} | out

    return map_batches(grouped, run, schema)
