"""WAV files by byte ranges against whole files, in bounded memory, with filters that reach the bytes."""

import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan
from voxframe.sources import audio


def wav(path, raw, rate, channels, width, kind=1, extra=b"", size=None):
    body = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * width, channels * width, 8 * width)
    data = len(raw) if size is None else size
    path.write_bytes(b"RIFF" + struct.pack("<I", 36 + data) + b"WAVEfmt " + struct.pack("<I", 16) + body + extra + b"data" + struct.pack("<I", data) + raw)


def whole(content, frame_ms=30, rate=16_000):
    """Powers of a whole file's samples."""
    x, step = audio.pcm(content, rate).astype(np.float64), rate * frame_ms // 1000
    return (x[: len(x) // step * step].reshape(-1, step) ** 2).mean(axis=1)


KINDS = [(16_000, 1, 2), (8_000, 1, 2), (44_100, 2, 2), (48_000, 6, 2), (11_025, 1, 1), (16_000, 2, 3), (22_050, 1, 4)]


@pytest.mark.parametrize("size", [100, 4_001, 1 << 30])
def test_ranges_give_the_whole_files_frames(tmp_path, monkeypatch, size):
    rng = np.random.default_rng(1)
    for k, (rate, channels, width) in enumerate(KINDS):
        n = rate // (1 if size > 100 else 12) + 7
        wav(tmp_path / f"{k}.wav", rng.integers(0, 256, n * channels * width, np.uint8).tobytes(), rate, channels, width, extra=b"LIST" + struct.pack("<I", 3) + b"abc\0")
    (tmp_path / "notes.txt").write_text("x")
    monkeypatch.setattr(audio, "CHUNK", 2_000)
    reader = audio.FrameReader({"path": f"file://{tmp_path}/*.wav", "rangebytes": str(size)})
    parts = reader.partitions()
    assert sum(len(p.spans) for p in parts) >= len(KINDS) and (len(parts) > 100 or size > 100)
    got = {}
    for part in parts:
        for batch in reader.read(part):
            for r in batch.to_pylist():
                assert r["start_ms"] == 30 * r["frame_no"]
                got.setdefault(r["recording"][-5], []).append((r["frame_no"], r["power"]))
    for k in range(len(KINDS)):
        want = whole((tmp_path / f"{k}.wav").read_bytes())
        mine = sorted(got[str(k)])
        assert [f for f, _ in mine] == list(range(len(want))) and [p for _, p in mine] == want.tolist()


def four_hours(tmp_path):
    path, size = tmp_path / "four-hours.wav", 16_000 * 4 * 3600 * 2
    wav(path, b"", 16_000, 1, 2, size=size)
    with path.open("r+b") as f:
        f.seek(44 + size - 2)
        f.write(b"\x10\x00")
    return path


def test_four_hours_in_less_than_two_mebibytes(spark, tmp_path):
    path = four_hours(tmp_path)
    reader = audio.FrameReader({"path": f"file://{path}"})
    last = 4 * 3600 * 1000 - 1000
    assert list(reader.pushFilters([GreaterThanOrEqual(("start_ms",), last)])) == []
    parts = reader.partitions()
    tracemalloc.start()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(parts) >= 13 and [r["start_ms"] for r in rows] == list(range(-(-last // 30) * 30, last + 971, 30)) and rows[-1]["power"] > 0 and peak < 2 << 20
    probe = audio.ProbeReader({"path": f"file://{path}", "minms": "400", "maxms": str(4 * 3600 * 1000), "maxbytes": str(1 << 30)})
    tracemalloc.start()
    (facts,) = [r for p in probe.partitions() for r in probe.read(p)]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert facts[4] == 14_400_000 and facts[7] is None and peak < 3 << 20
    wanted = spark.createDataFrame([(f"file://{path}", last, last + 1000)], "path string, start_ms long, end_ms long")
    assert len(audio.regions(wanted).first().pcm) == 32_000
    df = audio.power_frames(spark, f"file://{path}")
    assert df.count() == 480_000 and df.rdd.getNumPartitions() >= 13


def test_only_the_bytes_that_a_filter_needs_are_read(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    for k in range(3):
        wav(tmp_path / f"{k}.wav", rng.integers(0, 256, 320_000, np.uint8).tobytes(), 16_000, 1, 2)
    read = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, n=-1):
            out = self.file.read(n)
            read.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.file, name)

    plain = audio.opened
    monkeypatch.setattr(audio, "opened", lambda url: Counted(plain(url)))
    reader = audio.FrameReader({"path": f"file://{tmp_path}", "rangebytes": "50000"})
    unhandled = EqualTo(("power",), 1.0)
    name = f"file://{tmp_path}/1.wav"
    assert list(reader.pushFilters([EqualTo(("recording",), name), GreaterThanOrEqual(("start_ms",), 3000), LessThan(("start_ms",), 3300), unhandled])) == [unhandled]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["start_ms"] for r in rows] == list(range(3000, 3300, 30)) and {r["recording"] for r in rows} == {name}
    assert sum(read) < 12_000
    df = audio.power_frames(spark, f"file://{tmp_path}").filter((F.col("start_ms") > 3000) & (F.col("start_ms") <= 3300) & F.col("recording").isin(name, "other"))
    assert sorted(r.start_ms for r in df.collect()) == list(range(3030, 3301, 30))
    assert audio.power_frames(spark, f"file://{tmp_path}").filter("start_ms = 3010").count() == 0
    assert audio.power_frames(spark, f"file://{tmp_path}").filter("start_ms = 3000").count() == 3


def test_files_that_are_none(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"nonsense")
    (tmp_path / "b.wav").write_bytes(b"")
    wav(tmp_path / "c.wav", bytes(32_000), 16_000, 1, 2, kind=3)  # floating point
    wav(tmp_path / "d.wav", bytes(31_999), 16_000, 1, 2, size=99_999)  # cut off
    wav(tmp_path / "e.wav", bytes(96_000), 16_000, 1, 2, kind=0xFFFE)
    got = {r.recording[-5]: (r.error, r.duration_ms, r.codec, r.sha256 is None) for r in audio.probed(spark, f"file://{tmp_path}", digest=False).collect()}
    assert got == {"a": ("AUDIO_PROBE_FAILED", None, None, True), "b": ("AUDIO_EMPTY", None, None, True), "c": ("AUDIO_PROBE_FAILED", None, None, True), "d": (None, 1000, "pcm_s16le", True), "e": (None, 3000, "pcm_s16le", True)}
    df = audio.power_frames(spark, f"file://{tmp_path}", skip_unreadable=True)
    assert {r.recording[-5]: r.n for r in df.groupBy("recording").agg(F.count("*").alias("n")).collect()} == {"d": 33, "e": 100}
    with pytest.raises(Exception, match="AUDIO_UNREADABLE"):
        audio.power_frames(spark, f"file://{tmp_path}").collect()
    assert audio.power_frames(spark, f"file://{tmp_path}/none/*.wav").collect() == audio.probed(spark, f"file://{tmp_path}/none").collect() == []
