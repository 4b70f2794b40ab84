"""PII: format-preserving Feistel pseudonyms.

Validated values are replaced by others of the same format under a keyed permutation, so equal values
stay linked across documents and different values stay apart. Each kind has its domain, ``[0, N)``;
an alternating Feistel network over a x b >= N with keyed BLAKE2b rounds permutes it, walking cycles
until it is back inside.

kind   | valid if                                   | permuted                  | kept
card   | 13-19 digits, plain or in groups, Luhn sum right | digits 2 to the last but 1 | first digit, separators; check digit made anew
phone  | +country and 7-12 digits, or 3-3-4 digits  | national digits           | country code (by the list of codes, however spaced), layout
ip     | four decimals of 0-255                     | all 32 bits               | dotted form
email  | local@domain.tld                           | letters and digits by class, domain too, in lower case | punctuation, letter case by place, top-level domain
ssn    | 3-2-4 digits, no void group                | the valid numbers         | hyphens
iban   | mod-97 sum right, in upper or lower case   | letters and digits by class | country; check digits made anew, letter case
date   | calendar date 1900 to 2099, Y-M-D or D/M/Y or D.M.Y | the day         | layout

Digits are those of ASCII: numbers in other scripts are no values of these kinds and stay, in every text. An
address links to its spellings in other letter case, as the permuted letters are those in lower case.

Edge cases: a null text stays null and an empty one empty; numbers that fail validation stay as they
are; of two kinds that match at one place the first of ``PATTERN`` is taken, and the next if that one is not
valid from the next character on; repeated rows get equal pseudonyms; time is linear in a very long text; an empty table gives an empty result. Other columns pass
through; the operator's columns replace columns of the same name.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import bound_batches, byte_class, map_batches, slabs

KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "date")
ROUNDS = 8
DIGIT_OR_AT = byte_class((48, 57), (64, 64))
#: The country codes of one and two digits; all others have three. None begins another.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

PATTERN = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![A-Za-z0-9]))
|(?P<iban>(?<![A-Za-z0-9])(?:[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?:[ ]?[a-z0-9]{4}){2,7}(?:[ ]?[a-z0-9]{1,3})?)(?![A-Za-z0-9]))
|(?P<date>(?<![\d./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![\d/-]|\.\d))
|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d))
|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
|(?P<phone>(?<![\w+])(?:(?:\+1[ .-]?)?\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|(?:\+1[ .-]?)?\d{3}[.-]\d{3}[.-]\d{4}|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4})(?![\d-]))
|(?P<card>(?<![A-Za-z0-9-])(?:\d{13,19}|\d{4}(?P<gap>[ -])(?:\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{6}(?P=gap)\d{5}))(?![A-Za-z0-9-]))""",
    re.VERBOSE | re.ASCII,
)


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10


class Feistel:
    """Keyed permutations of ``[0, n)``."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: bytes, k: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%x" % (k, x), key=self.key, person=tweak[:16], digest_size=32).digest(), "big")

    def permute(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        """The image of ``x``, or with ``back`` what is mapped to it."""
        if n < 2:
            return x
        a = 1 << ((n - 1).bit_length() + 1) // 2
        b = -(-n // a)
        while True:
            left, right = divmod(x, a)
            for k in range(ROUNDS) if not back else range(ROUNDS - 1, -1, -1):
                sign = -1 if back else 1
                if k % 2 == 0:
                    left = (left + sign * self._f(tweak, k, right)) % b
                else:
                    right = (right + sign * self._f(tweak, k, left)) % a
            x = left * a + right
            if x < n:
                return x

    # --- kinds

    def digits(self, text: str, tweak: bytes, back: bool) -> str:
        return str(self.permute(int(text), 10 ** len(text), tweak + b"%d" % len(text), back)).zfill(len(text)) if text else ""

    def by_class(self, text: str, tweak: bytes, back: bool) -> str:
        """Permute letters and digits, each within its class; what else there is stays."""
        sizes = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in text]
        x, n = 0, 1
        for c, s in zip(text, sizes):
            x = x * s + (ord(c) - (48 if s == 10 else 97 if c.islower() else 65) if s > 1 else 0)
            n *= s
        shape = "".join("9" if s == 10 else c if s == 1 else "a" if c.islower() else "A" for c, s in zip(text, sizes))
        x = self.permute(x, n, tweak + hashlib.blake2b(shape.encode(), digest_size=8).digest(), back)
        out = []
        for c, s in zip(reversed(shape), reversed(sizes)):
            x, d = divmod(x, s)
            out.append(c if s == 1 else chr(d + (48 if s == 10 else 97 if c == "a" else 65)))
        return "".join(reversed(out))

    def value(self, kind: str, text: str, back: bool = False) -> str | None:
        """The pseudonym of a value, None if it is not valid; with ``back``, what it stands for."""
        return getattr(self, f"_{kind}")(text, back)

    def _email(self, text: str, back: bool) -> str | None:
        local, _, domain = text.rpartition("@")
        name, _, top = domain.rpartition(".")
        new = self.by_class(local.lower(), b"local", back) + "@" + self.by_class(name.lower(), b"domain", back)
        return "".join(c.upper() if old.isupper() else c for c, old in zip(new, text)) + "." + top

    def _phone(self, text: str, back: bool) -> str | None:
        head = ""
        if text[0] == "+":
            n = next((n for n in (1, 2) if re.sub(r"\D", "", text)[:n] in CODES), 3)
            head = re.match(rf"\+(?:\D*\d){{{n}}}", text)[0]
        own = re.sub(r"\D", "", text[len(head) :])
        if not 7 <= len(own) <= 12:
            return None
        return head + fill(text[len(head) :], self.digits(own, b"phone", back))

    def _card(self, text: str, back: bool) -> str | None:
        own = re.sub(r"\D", "", text)
        if luhn(own) or not own.strip(own[0]):
            return None
        body = own[0] + self.digits(own[1:-1], b"card", back)
        return fill(text, body + str((10 - luhn(body + "0")) % 10))

    def _ip(self, text: str, back: bool) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = self.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip", back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _ssn(self, text: str, back: bool) -> str | None:
        a, b, c = map(int, text.split("-"))
        areas = [*range(1, 666), *range(667, 900)]
        if not (0 < a < 900 and a != 666 and b and c):
            return None
        x = self.permute((areas.index(a) * 99 + b - 1) * 9999 + c - 1, len(areas) * 99 * 9999, b"ssn", back)
        x, c = divmod(x, 9999)
        a, b = divmod(x, 99)
        return f"{areas[a]:03d}-{b + 1:02d}-{c + 1:04d}"

    def _iban(self, text: str, back: bool) -> str | None:
        own = text.replace(" ", "").upper()
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(own) <= 34 or number(own[4:] + own[:4]) % 97 != 1:
            return None
        body = self.by_class(own[4:], b"iban", back)
        made = own[:2] + f"{98 - number(body + own[:2] + '00') % 97:02d}" + body
        it = iter(made.lower() if text[0].islower() else made)
        return "".join(c if c == " " else next(it) for c in text)

    def _date(self, text: str, back: bool) -> str | None:
        form = "%Y-%m-%d" if text[4] == "-" else "%d/%m/%Y" if text[2] == "/" else "%d.%m.%Y"
        try:
            day = dt.datetime.strptime(text, form).date()
        except ValueError:
            return None
        low = dt.date(1900, 1, 1)
        n = (dt.date(2100, 1, 1) - low).days
        return (low + dt.timedelta(self.permute((day - low).days, n, b"date", back))).strftime(form)


def fill(layout: str, digits: str) -> str:
    """``layout`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def find(text: str):
    """Candidate values as (kind, start, end), leftmost first, none overlapping another.

    A candidate that fails validation is looked at again from its next character on, so that a valid
    value inside it is still found.
    """
    at = 0
    while m := PATTERN.search(text, at):
        kind = next(k for k in KINDS if m[k] is not None)
        ok = yield kind, m.start(), m.end()
        at = m.end() if ok else m.start() + 1


def pseudonymise_text(text: str, feistel: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind were replaced."""
    out, last, counts = [], 0, {}
    scan = find(text)
    ok = None
    while True:
        try:
            kind, a, b = scan.send(ok)
        except StopIteration:
            break
        new = feistel.value(kind, text[a:b], back)
        ok = new is not None
        if ok:
            out += [text[last:a], new]
            last = b
            counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[last:]]), counts


def pseudonymise(docs: DataFrame, key: bytes, *, text: str = "text") -> DataFrame:
    """Replace the values in ``text`` and add ``n_email``, ``n_phone`` and so on, one count for each kind."""
    bound_batches(docs.sparkSession)
    names = [f"n_{k}" for k in KINDS]
    base = docs.drop(*names)
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def run(batch: pa.RecordBatch) -> dict:
        feistel = Feistel(key)
        col = batch.column(text)
        counts = {n: np.zeros(len(col), np.int64) for n in names}
        changed: dict[int, str] = {}
        for slab in slabs(col):
            marks = np.concatenate([[0], np.cumsum(DIGIT_OR_AT[slab.buf])])
            for k in np.flatnonzero(marks[slab.offs[1:]] > marks[slab.offs[:-1]]).tolist():
                new, found = pseudonymise_text(slab.text(k).decode(), feistel)
                if found:
                    changed[slab.lo + k] = new
                    for kind, n in found.items():
                        counts[f"n_{kind}"][slab.lo + k] = n
        if changed:
            rows = col.to_pylist()
            for k, new in changed.items():
                rows[k] = new
            col = pa.array(rows, batch.column(text).type)
        return {n: col if n == text else batch.column(n) for n in batch.schema.names} | counts

    return map_batches(base, run, schema)
