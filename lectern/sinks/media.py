"""Small media containers of given properties, without media: what a recorder's headers say, for replays and tests."""

from __future__ import annotations

import struct


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def mp4(duration: float, frame_rate: int, width: int, height: int, codec: str = "avc1", sound: tuple[str, int, int] | None = None, data: int = 0) -> bytes:
    """An MP4 of one video track, and with ``sound`` (codec, channels, rate) an audio track; ``data`` bytes of nothing come first."""
    unit = 90_000
    long = round(duration * unit)
    full = lambda *fields: b"\0\0\0\0" + b"".join(fields)
    head = lambda kind: box(kind, full(struct.pack(">IIII", 0, 0, unit, long)))

    def track(role: bytes, entry: bytes, count: int, delta: int) -> bytes:
        tables = box(b"stbl", box(b"stsd", full(struct.pack(">I", 1), entry)), box(b"stts", full(struct.pack(">III", 1, count, delta))))
        return box(b"trak", box(b"mdia", head(b"mdhd"), box(b"hdlr", full(b"\0" * 4, role, b"\0" * 13)), box(b"minf", tables)))

    video = track(b"vide", box(codec.encode(), b"\0" * 24, struct.pack(">HH", width, height), b"\0" * 50), round(duration * frame_rate), unit // frame_rate)
    audio = b""
    if sound:
        audio = track(b"soun", box(sound[0].encode(), b"\0" * 16, struct.pack(">HHI", sound[1], 16, 0), struct.pack(">I", sound[2] << 16)), 1, long)
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"mdat", b"\0" * data) + box(b"moov", head(b"mvhd"), video, audio)


def wav(duration: float, rate: int, channels: int = 1) -> bytes:
    """Silence of 16 bits."""
    data = b"\0" * (round(duration * rate) * channels * 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 4 + len(fmt) + 8 + len(data)) + b"WAVE" + fmt + struct.pack("<4sI", b"data", len(data)) + data
