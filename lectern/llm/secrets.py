"""Secret scans by one deterministic automaton for all rules.

Every rule is a regular expression over bytes. All rules together become a nondeterministic automaton
(Thompson), then, unanchored, a deterministic one by subset construction, and a least one by partition
refinement; its transitions are one array over byte classes. One pass over the bytes gives the state
after each byte, and with it which rules have a match ending there. A second array, of the reversed
rule, run backward from an end, gives the leftmost start of that match.

The pass itself is vectorised: the bytes are cut into lanes that all start in the initial state and
advance together; a lane whose true start state differs, as the lane before it shows, is run again from
its start until it meets the states already found.

Within a rule matches are leftmost, longest, and do not overlap; a match that fails the rule's least
length is dropped, its characters stay used. This equals backtracking search for rules in which no two
alternatives can match the same bytes, as all of ``RULES``.

Edge cases: a null or empty text has no spans; of rules that match at one place each gives its span, in the
rules' order; repeated rows are scanned alike; a very long text is a slab by itself, so memory follows the
longest text and time is linear; an empty table gives an empty result. Other columns pass through; the operator's columns replace columns of the same name.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import bound_batches, map_batches, slabs


#: Bytes of one pass; long lanes need fewer repairs at their starts.
SCAN_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``least`` is the fewest characters of the match, or of the group's run at its end."""

    kind: str
    pattern: str
    least: int = 1
    tail: bool = False


ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
RULES = (
    Rule("assign", ASSIGN, 6, tail=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


# --- expressions: literals, escapes, [...], (...), |, ?, *, +


class Parser:
    """Reads a pattern into a tree of ('set', bytes), ('cat', ...), ('alt', ...), ('star'|'plus'|'opt', x)."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def parse(self):
        tree = self.alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in {self.text!r}")
        return tree

    def alternatives(self):
        found = [self.sequence()]
        while self.text[self.at : self.at + 1] == "|":
            self.at += 1
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            item = self.single()
            while self.at < len(self.text) and self.text[self.at] in "?*+":
                item = ({"?": "opt", "*": "star", "+": "plus"}[self.text[self.at]], item)
                self.at += 1
            found.append(item)
        return ("cat", found)

    def single(self):
        c = self.text[self.at]
        if c == "(":
            self.at += 1
            tree = self.alternatives()
            if self.text[self.at : self.at + 1] != ")":
                raise ValueError(f"missing ) in {self.text!r}")
            self.at += 1
            return tree
        if c == "[":
            return ("set", self.members())
        return ("set", frozenset([self.char()]))

    def char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def members(self) -> frozenset[int]:
        self.at += 1
        negate = self.text[self.at] == "^"
        self.at += negate
        found: set[int] = set()
        while self.text[self.at] != "]":
            a = self.char()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                found.update(range(a, self.char() + 1))
            else:
                found.add(a)
        self.at += 1
        return frozenset(range(256)) - found if negate else frozenset(found)


def reverse(tree):
    kind, body = tree
    if kind == "cat":
        return kind, [reverse(x) for x in reversed(body)]
    if kind == "alt":
        return kind, [reverse(x) for x in body]
    return tree if kind == "set" else (kind, reverse(body))


class Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Build ``tree`` from ``start`` on; the state in which it ends."""
        kind, body = tree
        if kind == "set":
            end = self.state()
            self.moves[start].append((body, end))
            return end
        if kind == "cat":
            for x in body:
                start = self.add(x, start)
            return start
        end = self.state()
        if kind == "alt":
            for x in body:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(x, own)].append(end)
            return end
        own = self.state()
        self.empty[start].append(own)
        last = self.add(body, own)
        self.empty[last].append(end)
        if kind != "plus":
            self.empty[start].append(end)
        if kind != "opt":
            self.empty[last].append(own)
        return end

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Dfa:
    """A least deterministic automaton: ``table[state, byte]`` and the rules that accept, as bits."""

    def __init__(self, trees: list, unanchored: bool):
        nfa = Nfa()
        root = nfa.state()
        for k, tree in enumerate(trees):
            own = nfa.state()
            nfa.empty[root].append(own)
            nfa.accepts[nfa.add(tree, own)] = k
        start = nfa.closure([root])
        ids, order, rows = {start: 0}, [start], []
        for now in order:
            to: dict[int, set[int]] = defaultdict(set)
            for s in now:
                for members, end in nfa.moves[s]:
                    for b in members:
                        to[b].add(end)
            row = []
            known: dict[frozenset[int], int] = {}
            for b in range(256):
                key = frozenset(to.get(b, ()))
                if key not in known:
                    nxt = nfa.closure(key | ({root} if unanchored else set()))
                    if nxt not in ids:
                        ids[nxt] = len(ids)
                        order.append(nxt)
                    known[key] = ids[nxt]
                row.append(known[key])
            rows.append(row)
        marks = [sum(1 << nfa.accepts[s] for s in now if s in nfa.accepts) for now in order]
        self._least(np.array(rows), np.array(marks), None if unanchored else ids.get(frozenset()))

    def _least(self, table: np.ndarray, marks: np.ndarray, dead: int | None) -> None:
        """Moore's refinement: states part while their marks or the classes they lead to differ."""
        part = np.unique(marks, return_inverse=True)[1]
        while True:
            rows = np.concatenate([part[:, None], part[table]], axis=1)
            fresh = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
            if fresh.max() == part.max():
                break
            part = fresh
        # the initial state becomes 0
        first = list(dict.fromkeys(part.tolist()))
        name = np.empty(len(first), np.int64)
        name[first] = np.arange(len(first))
        part = name[part]
        pick = np.array([int(np.flatnonzero(part == k)[0]) for k in range(len(first))])
        kind = np.uint8 if len(first) <= 256 else np.uint16 if len(first) <= 65536 else np.uint32
        self.table = part[table[pick]].astype(kind)
        self.marks = marks[pick]
        self.dead = None if dead is None else int(part[dead])

    def states(self, buf: np.ndarray, restart: np.ndarray, lanes: int = 2048) -> np.ndarray:
        """The state after each byte, from the initial state at each of the offsets ``restart`` on."""
        n = len(buf)
        # byte value 255 is in no UTF-8 text: it stands for a text's end and leads to the initial state
        width = max(64, -(-n // lanes))
        count = max(1, -(-n // width))
        padded = np.full(count * width, 255, np.uint8)
        padded[:n] = buf
        steps = np.ascontiguousarray(padded.reshape(count, width).T)
        table = self.table.copy()
        table[:, 255] = 0
        flat = table.ravel()
        out = np.empty((width, count), table.dtype)
        now = np.zeros(count, np.intp)
        for t in range(width):
            np.take(flat, now * 256 + steps[t], out=out[t])
            now = out[t].astype(np.intp)
        state = np.ascontiguousarray(out.T).ravel()
        rows = self.table.tolist()
        heads = set(restart.tolist())
        # where a lane or a text starts in another state than was assumed
        for k in sorted({*range(width, count * width, width), *heads}):
            if k >= n:
                continue
            s = 0 if k in heads or k == 0 else int(state[k - 1])
            if k % width == 0 and s == 0:
                continue
            i = k
            while i < n and (i == k or i not in heads):
                s = rows[s][buf[i]]
                if s == state[i]:
                    break
                state[i] = s
                i += 1
        return state[:n]

    def longest_back(self, data: bytes, end: int, low: int) -> int:
        """Start of the longest match of this (reversed, anchored) automaton that ends at ``end``, or -1."""
        s, best = 0, -1
        for i in range(end - 1, low - 1, -1):
            s = int(self.table[s, data[i]])
            if s == self.dead:
                break
            if self.marks[s]:
                best = i
        return best


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        trees = [Parser(r.pattern).parse() for r in rules]
        self.rules = rules
        self.forward = Dfa(trees, True)
        self.backward = [Dfa([reverse(t)], False) for t in trees]
        self.plain = [self._plain(k) for k in range(len(rules))]

    def scan(self, slab) -> list[list[tuple[int, int, int]]]:
        """For each text the spans (start, rule, end) in bytes, sorted."""
        n = len(slab.buf)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(slab.hi - slab.lo)]
        if not n:
            return found
        heads = slab.offs[:-1][slab.offs[:-1] < slab.offs[1:]]
        state = self.forward.states(slab.buf, heads)
        for k, rule in enumerate(self.rules):
            marks = ((self.forward.marks >> k) & 1).astype(np.uint8)[state]
            # runs of bytes at which the rule accepts, cut where a text ends
            edge = np.zeros(n + 1, bool)
            np.not_equal(marks[1:], marks[:-1], out=edge[1:n])
            edge[0] = edge[n] = True
            edge[heads] = True
            cut = np.flatnonzero(edge)
            size = np.diff(cut)
            # a run shorter than the least length cannot end a long enough match unless the match has a head
            own = np.flatnonzero(marks[cut[:-1]] == 1)
            if not rule.tail and self.plain[k]:
                own = own[size[own] >= rule.least]
            text = np.searchsorted(slab.offs, cut[own], "right") - 1
            last_text, last_end = -1, 0
            for row, a, e in zip(text.tolist(), cut[own].tolist(), (cut[own] + size[own]).tolist()):
                low = int(slab.offs[row])
                if row != last_text:
                    last_text, last_end = row, low
                start = a
                if not self.plain[k]:
                    # what was used is never looked at again, so this stays linear in the text
                    start = self.backward[k].longest_back(slab.buf[last_end:e].tobytes(), e - last_end, 0)
                    if start < 0:
                        continue
                    start += last_end
                last_end = e
                length = e - a if rule.tail else e - start
                if length >= rule.least:
                    found[row].append((start - low, k, e - low))
        return [sorted(x) for x in found]

    def _plain(self, k: int) -> bool:
        """Whether the rule is one class repeated: its run of accepting bytes is the match."""
        kind, body = Parser(self.rules[k].pattern).parse()
        return kind == "cat" and len(body) == 1 and body[0][0] == "plus" and body[0][1][0] == "set"


def scan_secrets(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``secrets``: an array of structs (kind, start, end) in code points, by start, then in the rules' order."""
    bound_batches(docs.sparkSession)
    base = docs.drop("secrets")
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*base.schema.fields, T.StructField("secrets", T.ArrayType(item))])
    made: list[Scanner] = []
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    def run(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(shared.value)
        out = []
        for slab in slabs(batch.column(text), SCAN_BYTES):
            scanned = made[0].scan(slab)
            # code points before each byte, once a slab
            chars = np.concatenate([[0], np.cumsum((slab.buf & 0xC0) != 0x80)]) if any(scanned) else None
            for low, spans in zip(slab.offs.tolist(), scanned):
                if spans:
                    begin, kinds, end = (np.array(x) for x in zip(*spans))
                    begin, end = (chars[low + x] - chars[low] for x in (begin, end))
                    spans = [{"kind": rules[r].kind, "start": a, "end": e} for r, a, e in zip(kinds.tolist(), begin.tolist(), end.tolist())]
                out.append(spans)
        return {n: batch.column(n) for n in batch.schema.names} | {"secrets": out}

    return map_batches(base, run, schema)
