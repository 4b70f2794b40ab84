"""Duration, frame rate and codec of media files from their containers: boxes of MP4 and chunks of WAV, by byte ranges.

Tasks list the files (``files.found``); each is opened where it is looked at, and only headers are read: the media data are stepped over, whatever
their size. A file that is neither, or is cut short before its headers, has nulls.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "video_id string, path string, length long, kind string, duration double, codec string, frame_rate double, n_frames long, width int, height int, audio_codec string, sample_rate int, channels int"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")][3:]
#: Bytes of a table of sample times that are read at once.
BLOCK = 1 << 20


class Ranges:
    """Byte ranges of a file; what lies behind its end is an error."""

    def __init__(self, f, length: int):
        self.f, self.length = f, length

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        got = self.f.read(n)
        if len(got) < n:
            raise EOFError
        return got


def boxes(r: Ranges, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, begin and end of the contents of the boxes of a range."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", r.read(at, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", r.read(at + 8, 8))[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield kind, at + head, min(at + size, end)
        at += size


def find(r: Ranges, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    """The contents of the first box on a path."""
    for kind, a, b in boxes(r, at, end):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else find(r, a, b, *path[1:])
    return None


def times(r: Ranges, at: int) -> tuple[int, int]:
    """Units of a second and length of a movie or media header."""
    if r.read(at, 1)[0] == 1:
        return struct.unpack(">IQ", r.read(at + 20, 12))
    return struct.unpack(">II", r.read(at + 12, 8))


def samples(r: Ranges, at: int, end: int) -> tuple[int, int]:
    """Number of samples and their time, from the table of times."""
    n = struct.unpack(">I", r.read(at + 4, 4))[0]
    at, end = at + 8, min(end, at + 8 + 8 * n)
    count = total = 0
    while at + 8 <= end:
        part = r.read(at, min(BLOCK, (end - at) // 8 * 8))
        for c, d in struct.iter_unpack(">II", part):
            count, total = count + c, total + c * d
        at += len(part)
    return count, total


def probe_mp4(r: Ranges) -> dict | None:
    movie = find(r, 0, r.length, b"moov")
    if movie is None:
        return None
    out = {"kind": "mp4"}
    head = find(r, *movie, b"mvhd")
    if head:
        unit, long = times(r, head[0])
        out["duration"] = long / unit if unit else None
    for kind, a, b in boxes(r, *movie):
        media = find(r, a, b, b"mdia") if kind == b"trak" else None
        handler = media and find(r, *media, b"hdlr")
        table = media and find(r, *media, b"minf", b"stbl")
        entry = table and find(r, *table, b"stsd")
        if not handler or not entry:
            continue
        role, first = r.read(handler[0] + 8, 4), entry[0] + 8
        codec = r.read(first + 4, 4).decode("latin-1")
        if role == b"vide" and "codec" not in out:
            out["codec"] = codec
            out["width"], out["height"] = struct.unpack(">HH", r.read(first + 32, 4))
            stts, units = find(r, *table, b"stts"), find(r, *media, b"mdhd")
            if stts and units:
                count, total = samples(r, *stts)
                out["n_frames"] = count
                out["frame_rate"] = count * times(r, units[0])[0] / total if total else None
        elif role == b"soun" and "audio_codec" not in out:
            out["audio_codec"] = codec
            out["channels"], out["sample_rate"] = struct.unpack(">H", r.read(first + 24, 2))[0], struct.unpack(">I", r.read(first + 32, 4))[0] >> 16
    return out


def probe_wav(r: Ranges) -> dict | None:
    if r.length < 12 or r.read(0, 4) != b"RIFF" or r.read(8, 4) != b"WAVE":
        return None
    out, at, each = {"kind": "wav"}, 12, 0
    while at + 8 <= r.length:
        kind, size = struct.unpack("<4sI", r.read(at, 8))
        if kind == b"fmt ":
            form, channels, rate, each = struct.unpack("<HHII", r.read(at + 8, 12))
            out |= {"audio_codec": {1: "pcm", 3: "float", 6: "alaw", 7: "mulaw"}.get(form, str(form)), "channels": channels, "sample_rate": rate}
        if kind == b"data":
            out["duration"] = min(size, r.length - at - 8) / each if each else None
            return out
        at += 8 + size + size % 2
    return out


def probe(f, length: int) -> dict:
    """What a file's headers tell; an empty answer for a file of another kind."""
    r = Ranges(f, length)
    try:
        return probe_wav(r) or probe_mp4(r) or {}
    except (EOFError, struct.error):
        return {}


def probes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A row for each file of a folder, folders below included."""
    from ..sinks.committed import located
    from .files import found as listed

    files = listed(spark, path, glob)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                target, where = located(name)
                with target.open_input_file(where) as f:
                    found = probe(f, length)
                rows.append({"video_id": name.rsplit("/", 1)[-1].rsplit(".", 1)[0], "path": name, "length": length} | {k: found.get(k) for k in FIELDS})
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], SCHEMA).schema)
    return files.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, SCHEMA)
