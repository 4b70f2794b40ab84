"""Text: trimming, cutting, paragraphs, names, fingerprints.

``strip`` and white-space classes follow Unicode, not only ASCII blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of letters, digits or underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
#: What names may not hold, and what marks the end of a reply.
UNSAFE, FINAL = r"[^A-Za-z0-9_-]+", r"(?s)Final Caption:\s*(.*)"
#: How a model's failures begin.
MARKS = ("[Error:", "[Error parsing stream:", "[No content received")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({WORD})"), 1)).cast("long")


def word_set(c: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), 1))


def word_keys(c: Column) -> Column:
    """64-bit hashes of the distinct words: sets of them are compared several times as fast."""
    return F.transform(word_set(c), lambda w: F.xxhash64(w))


def summarise(c: Column, most: int = 600) -> Column:
    """Squeezed; if longer than ``most``, cut there, without the last partial word, and marked."""
    s = squeeze(c)
    head = F.substring(s, 1, most)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(cut, F.lit(" ...")))


def truncate(c: Column, most: int, mark: str = " …") -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(rstrip(F.substring(c, 1, most)), F.lit(mark)))


def paragraphs(c: Column) -> Column:
    """Paragraphs parted by two or more newlines; single newlines become blanks."""
    parts = F.filter(F.transform(F.split(strip(F.replace(c, F.lit("\r\n"), F.lit("\n"))), r"\n{2,}"), strip), lambda p: p != "")
    return F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"[ \t]*\n[ \t]*", " "), r"[ \t]{2,}", " "))


def lines(c: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), strip), lambda x: x != "")


def base64(c: Column) -> Column:
    """Base64 on one line; Spark's own breaks it behind every 76 characters."""
    return F.translate(F.base64(c), "\r\n", "")


def fingerprint(c: Column) -> Column:
    """The first 10 hex digits of the MD5."""
    return F.substring(F.md5(F.encode(c, "UTF-8")), 1, 10)


def safe_name(c: Column, fill: str = "_") -> Column:
    return F.regexp_replace(c, UNSAFE, fill)


def safe_file(c: Column) -> Column:
    return F.regexp_replace(c, r'[\\/*?:"<>|]', "")


def topic_text(title: Column, description: Column) -> Column:
    """Title and description on lines of their own, either left out where blank."""
    part = lambda x: F.nullif(strip(F.coalesce(x, F.lit(""))), F.lit(""))
    return F.concat_ws("\n", part(title), part(description))


def result_tag(n: Column, pen: Column, min_size: Column) -> Column:
    """``n<n>_p<p>_m<m>``, 0 for null."""
    zero = lambda x: F.coalesce(x.cast("string"), F.lit("0"))
    return F.concat(F.lit("n"), zero(n), F.lit("_p"), zero(pen), F.lit("_m"), zero(min_size))


def is_error(c: Column) -> Column:
    """Whether a model's text is one of the error marks."""
    return F.coalesce(F.greatest(*[F.startswith(c, F.lit(m)) for m in MARKS]), F.lit(False))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("yes", "y", "true", "t", "1"), F.lit(False))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def fixed(c: Column, digits: int, null: str = "") -> Column:
    """Decimal text with so many digits of the binary number, ties to even, as C and Python print it; ``null`` for null.

    Spark's own formatting takes the shortest decimal of a number and rounds its ties up.
    """
    x, p = c.cast("double"), float(10**digits)
    n = F.rint(x * p)
    # whether x * p lies beyond the halves around n, exactly: the upper and the lower bits of x are multiplied on their own
    upper = x.cast("float").cast("double")
    beyond = lambda half: ((upper * p - n) - half) + (x - upper) * p
    whole = F.when(beyond(0.5) > 0, n + 1).when(beyond(-0.5) < 0, n - 1).otherwise(n)
    printed = F.when(F.abs(x) < 2.0**50 / p, whole / p).otherwise(x)
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", printed)).otherwise(F.lit(null))


def any_keyword(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains one of the words anywhere."""
    return F.coalesce(F.greatest(*[F.contains(F.lower(c), F.lit(w)) for w in words]) if len(words) > 1 else F.contains(F.lower(c), F.lit(words[0])), F.lit(False))


def final_caption(c: Column, first: Column) -> Column:
    """What follows ``Final Caption:``, else the first caption."""
    return F.coalesce(F.nullif(strip(F.regexp_extract(c, FINAL, 1)), F.lit("")), first)


def renamed(c: Column, old: str, new: str) -> Column:
    """A name with the suffix ``old`` replaced; other names stay."""
    return F.when(F.endswith(c, F.lit(old)), F.concat(F.substring(c, F.lit(1), F.length(c) - len(old)), F.lit(new))).otherwise(c)
