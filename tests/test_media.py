import io
import struct

import pytest

from lectern.sinks import media as made
from lectern.sources import media


def probe(content):
    return media.probe(io.BytesIO(content), len(content))


@pytest.mark.parametrize("duration,rate,codec,sound", [(10.0, 25, "avc1", None), (0.5, 30, "hvc1", ("mp4a", 2, 44100)), (3600.0, 60, "vp09", ("Opus", 1, 48000))])
def test_mp4(duration, rate, codec, sound):
    got = probe(made.mp4(duration, rate, 1280, 720, codec, sound, 1000))
    assert got["kind"] == "mp4" and got["duration"] == pytest.approx(duration) and got["frame_rate"] == pytest.approx(rate)
    assert (got["codec"], got["width"], got["height"], got["n_frames"]) == (codec, 1280, 720, round(duration * rate))
    assert (got.get("audio_codec"), got.get("channels"), got.get("sample_rate")) == (sound or (None, None, None))


def test_wav():
    got = probe(made.wav(1.5, 8000, 2))
    assert got == {"kind": "wav", "audio_codec": "pcm", "channels": 2, "sample_rate": 8000, "duration": 1.5}


def test_boxes_of_other_sizes():
    """Sizes of 64 bits, a last box up to the end, headers of version 1, and frames of different length."""
    whole = made.mp4(2.0, 25, 640, 360)
    moov = whole[whole.index(b"moov") - 4 :]
    big = struct.pack(">I4sQ", 1, b"mdat", 16 + 5) + b"\0" * 5
    assert probe(big + moov)["duration"] == 2.0
    assert probe(big + struct.pack(">I4s", 0, b"moov") + moov[8:])["duration"] == 2.0
    head = made.box(b"mvhd", b"\1\0\0\0" + struct.pack(">QQIQ", 0, 0, 1000, 2500))
    assert probe(made.box(b"moov", head)) == {"kind": "mp4", "duration": 2.5}
    stts = b"\0\0\0\0" + struct.pack(">IIIII", 2, 3, 10, 1, 70)
    assert media.samples(media.Ranges(io.BytesIO(stts), len(stts)), 0, len(stts)) == (4, 100)


@pytest.mark.parametrize("content", [b"", b"RIFF", b"text of another kind", made.wav(1, 8000)[:20], struct.pack(">I4s", 4, b"moov") * 3])
def test_other_files(content):
    assert probe(content).get("duration") is None
    for n in range(0, len(made.mp4(1, 25, 2, 2)), 7):
        probe(made.mp4(1, 25, 2, 2)[:n])


def test_media_data_are_stepped_over():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            Counted.taken += n
            return super().read(n)

    content = made.mp4(10, 25, 4, 4, data=5_000_000)
    assert media.probe(Counted(content), len(content))["duration"] == 10 and Counted.taken < 5000
