"""Seconds and clock texts.

Milliseconds are rounded half to even and may come out as 1000, as the published files have them;
``carry=True`` moves that into the seconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clock(seconds: Column, dot: str, carry: bool) -> Column:
    s = F.bround(seconds, 3) if carry else seconds
    whole = F.floor(s)
    ms = F.bround((s - whole) * 1000, 0).cast("long")
    return F.format_string(f"%02d:%02d:%02d{dot}%03d", F.floor(whole / 3600).cast("long"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("long"), F.pmod(whole, F.lit(60)).cast("long"), ms)


def hms(seconds: Column, carry: bool = False) -> Column:
    """``HH:MM:SS.mmm``; negative seconds count as 0."""
    return _clock(F.greatest(F.lit(0.0), seconds), ".", carry)


def srt(seconds: Column, carry: bool = False) -> Column:
    """``HH:MM:SS,mmm``."""
    return _clock(seconds, ",", carry)


def seconds(c: Column) -> Column:
    """Seconds of a text of one to three parts parted by colons; null if it is none."""
    parts = F.split(F.regexp_replace(F.trim(c), ",", "."), ":")
    whole = lambda k: F.get(parts, F.lit(k)).try_cast("int")
    part = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return F.when(F.size(parts) == 1, part(0)).when(F.size(parts) == 2, whole(0) * 60 + part(1)).when(F.size(parts) == 3, whole(0) * 3600 + whole(1) * 60 + part(2))


def time_range(c: Column) -> Column:
    """Start and end of ``a-b`` or ``a–b``, parted at the first hyphen."""
    parts = F.split(F.replace(c, F.lit("–"), F.lit("-")), "-", 2)
    return F.struct(seconds(F.get(parts, F.lit(0))).alias("start_s"), seconds(F.get(parts, F.lit(1))).alias("end_s"))
