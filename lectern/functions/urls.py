"""Video ids and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The form of addresses and ids, on which results depend.
WATCH = "https://www.youtube.com/watch?v="
ADDRESS, TRAILING = r"https?://[^\s)\]>]+", r"""[:.,;!?")\]]+$"""
ID, ID_HEAD = r"^[A-Za-z0-9_-]{11}$", r"^[A-Za-z0-9_-]{6,}"
WATCH_LINK = r"(?U)(https://www\.youtube\.com/watch\?v=[\w-]+[&?=+\w]*)"


def first_url(c: Column) -> Column:
    """The first address in a text, without trailing punctuation; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, ADDRESS, 0), TRAILING, ""), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def param(url: Column, name: str) -> Column:
    """The first value of a query parameter; null if absent or empty."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def video_id(c: Column) -> Column:
    """The id in the first video address of a text, or null.

    Short addresses hold it as the head of their path, watch addresses as ``v``, embedded ones behind ``embed``.
    """
    url = first_url(c)
    head = F.nullif(F.regexp_extract(path(url), r"^/([^/]*)", 1), F.lit(""))
    embed = F.nullif(F.regexp_extract(path(url), r"/embed/([^/]+)", 1), F.lit(""))
    found = F.when(F.contains(host(url), F.lit("youtu.be")), head).otherwise(F.coalesce(param(url, "v"), embed))
    return F.when(F.contains(c, F.lit("youtu")), clean_id(found))


def clean_id(c: Column) -> Column:
    """The leading run of at least six id characters, else the text as it is."""
    return F.coalesce(F.nullif(F.regexp_extract(c, ID_HEAD, 0), F.lit("")), c)


def is_id(c: Column) -> Column:
    return F.coalesce(c.rlike(ID), F.lit(False))


def watch_url(video: Column) -> Column:
    return F.concat(F.lit(WATCH), video)


def shell_id(url: Column) -> Column:
    """``v=`` up to ``&`` if there is one, else what follows the last slash up to ``?``."""
    return F.when(F.contains(url, F.lit("v=")), F.regexp_extract(url, r"v=([^&]*)", 1)).otherwise(F.regexp_extract(url, r"([^/?]*)(?:\?.*)?$", 1))


def dir_id(p: Column) -> Column:
    """The folder's name; its parent's where it is a folder of frames."""
    frames = F.regexp_extract(p, r"([^/]+)/(?:raw_frames|frames|images)/*$", 1)
    return F.coalesce(F.nullif(frames, F.lit("")), F.regexp_extract(p, r"([^/]+)/*$", 1))


def links(c: Column) -> Column:
    """All watch links of a text, in order, repeats kept."""
    return F.regexp_extract_all(c, F.lit(WATCH_LINK), 1)


def extension(p: Column) -> Column:
    """Lower-cased, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1))
