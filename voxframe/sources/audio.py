"""WAV files by byte ranges: facts from their headers, powers of short frames, regions, clips.

Two data sources read a folder, a file or a pattern. `wav_probe` gives a row per file from its header alone (and a digest
in blocks of CHUNK bytes, if asked for). `wav_frames` gives a row per frame: byte ranges are planned from file sizes
alone, a frame belongs to the range in which its first sample lies, and a task reads CHUNK bytes at a time, so
recordings of any length are read by many tasks and none holds more than a chunk. Filters on `recording` are pushed to
the list of files, those on `start_ms` to the bytes that are read.

Samples of 8, 16, 24 and 32 bits are read as mono 16-bit ones: stereo is averaged, of more channels the first is taken;
another rate is interpolated, block by block with the values that the whole file would give. What is no WAV file is
AUDIO_UNREADABLE.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import re
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

CHUNK, RANGE, OPEN = 1 << 20, 32 << 20, 64 << 10
PROBE = "recording string, bytes bigint, sha256 string, codec string, duration_ms bigint, rate int, channels int, error string"
FRAMES = "recording string, frame_no bigint, start_ms bigint, power double"
#: WAV formats of whole-number samples.
PCM, EXTENSIBLE = 1, 0xFFFE


@dataclass
class Spans(InputPartition):
    """Byte ranges (url, size of the file, start, end) that one task reads."""

    spans: list


def listed(path: str) -> list[tuple[str, int]]:
    """Files (url, bytes) of a folder, a file or a pattern, by name."""
    fixed = re.split(r"[*?\[]", path, maxsplit=1)[0]
    base = path if fixed == path else fixed.rsplit("/", 1)[0]
    system, name = fs.FileSystem.from_uri(base)
    head = base[: len(base) - len(name)] if base.endswith(name) else "file://"
    if system.get_file_info(name).type == fs.FileType.File:
        infos = [system.get_file_info(name)]
    else:
        infos = system.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
    wanted = path[len(head) :] if path.startswith(head) else path
    return sorted((head + i.path, i.size) for i in infos if i.type == fs.FileType.File and (fixed == path or fnmatch.fnmatchcase(i.path, wanted)))


def planned(files: list[tuple[str, int]], size: int) -> list[Spans]:
    """Ranges of at most size bytes; small files share a task, as if opening one cost OPEN bytes."""
    parts, held, cost = [], [], 0
    for url, length in files:
        for start in range(0, max(length, 1), size):
            end = min(length, start + size)
            if held and cost + end - start + OPEN > size:
                parts.append(Spans(held))
                held, cost = [], 0
            held.append((url, length, start, end))
            cost += end - start + OPEN
    return [*parts, Spans(held)]  # without a file, one empty range


def opened(url: str):
    system, name = fs.FileSystem.from_uri(url)
    return system.open_input_file(name)


def wav_layout(file) -> tuple[int, int, int, int, int]:
    """(rate, channels, bytes a sample, where the samples start, their bytes) of an open WAV file, from its chunks' headers."""
    file.seek(0, 2)
    end = file.tell()
    file.seek(0)
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("AUDIO_UNREADABLE")
    form = None
    while len(head := file.read(8)) == 8:
        name, size = head[:4], int.from_bytes(head[4:], "little")
        if name == b"fmt ":
            body = file.read(min(size, 64))
            file.seek(max(0, size - len(body)) + size % 2, 1)
            kind, channels, rate, bits = (int.from_bytes(body[i:j], "little") for i, j in ((0, 2), (2, 4), (4, 8), (14, 16)))
            form = (rate, channels, bits // 8) if kind in (PCM, EXTENSIBLE) and bits in (8, 16, 24, 32) else None
        elif name == b"data":
            if form is None or not all(form):
                break
            at = file.tell()
            return (*form, at, max(0, min(size, end - at)))
        else:
            file.seek(size + size % 2, 1)
    raise ValueError("AUDIO_UNREADABLE")


def mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Raw samples as mono ones of 16 bits, in 32."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.int32) - 128) << 8
    elif width == 3:
        x = np.frombuffer(raw, np.uint8).reshape(-1, 3)[:, 1:].copy().view("<i2").astype(np.int32).ravel()
    else:
        x = np.frombuffer(raw, "<i2").astype(np.int32) if width == 2 else np.frombuffer(raw, "<i4") >> 16
    x = x.reshape(-1, channels)
    return x.sum(axis=1) // 2 if channels == 2 else x[:, 0]


def at_rate(x: np.ndarray, first: int, start: int, end: int, own: int, rate: int) -> np.ndarray:
    """Samples start to end at rate. x: the samples at the file's own rate, from its number `first` on, that they lie between."""
    if own != rate:
        x = np.interp(np.arange(start, end) * own / rate, np.arange(first, first + len(x)), x).round() if len(x) else x
    else:
        x = x[start - first : end - first]
    return np.clip(x, -32768, 32767).astype(np.int16)


def count_at(n: int, own: int, rate: int) -> int:
    """Samples at rate that n samples give."""
    return n if own == rate else int(n * rate / own)


def samples(raw: bytes, width: int, channels: int, own: int, rate: int) -> np.ndarray:
    """Raw samples as mono 16-bit ones at rate."""
    x = mono(raw, width, channels)
    return at_rate(x, 0, 0, count_at(len(x), own, rate), own, rate)


def pcm(content: bytes, rate: int = 16_000) -> np.ndarray:
    """A WAV file's samples, mono 16-bit at rate."""
    file = io.BytesIO(content)
    own, channels, width, at, size = wav_layout(file)
    return samples(content[at : at + size // (width * channels) * width * channels], width, channels, own, rate)


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))
        self.frame_ms, self.rate = int(options.get("framems", 30)), int(options.get("rate", 16_000))
        self.skip = options.get("onerror", "fail") == "skip"
        self.only, self.low, self.high = None, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("recording",) and isinstance(f, (EqualTo, In)):
                names = set(value if isinstance(f, In) else [value])
                self.only = names if self.only is None else self.only & names
            elif column == ("start_ms",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    last = value - isinstance(f, LessThan)
                    self.high = last if self.high is None else min(self.high, last)
                if isinstance(f, EqualTo):
                    yield f
            else:
                yield f

    def partitions(self) -> list[Spans]:
        return planned([x for x in listed(self.path) if self.only is None or x[0] in self.only], self.range)

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        for url, _, start, end in partition.spans:
            with opened(url) as file:
                try:
                    layout = wav_layout(file)
                except ValueError:
                    if self.skip:
                        continue
                    raise
                yield from self.frames(file, url, layout, start, end)

    def frames(self, file, url: str, layout: tuple, start: int, end: int) -> Iterator[pa.RecordBatch]:
        """Frames whose first sample lies in bytes start to end of the file."""
        own, channels, width, at, size = layout
        step, length = width * channels, self.rate * self.frame_ms // 1000
        n = size // step
        total = count_at(n, own, self.rate) // length
        # Frame f begins with the file's own sample floor(f * length * own / rate).
        first_from = lambda byte: max(0, -(-max(0, -(-(byte - at) // step)) * self.rate // (length * own)))
        a, b = first_from(start), min(total, first_from(end))
        a = max(a, -(-self.low // self.frame_ms))
        b = b if self.high is None else min(b, self.high // self.frame_ms + 1)
        many = max(1, CHUNK // max(1, length * own * step // self.rate))
        for f in range(a, b, many):
            g = min(b, f + many)
            low, high = f * length * own // self.rate, min(n, (g * length - 1) * own // self.rate + 2)
            file.seek(at + low * step)
            x = at_rate(mono(file.read((high - low) * step), width, channels), low, f * length, g * length, own, self.rate).astype(np.float64)
            power = (x.reshape(g - f, length) ** 2).mean(axis=1)
            number = np.arange(f, g)
            yield pa.RecordBatch.from_arrays([pa.array([url] * (g - f)), pa.array(number), pa.array(number * self.frame_ms), pa.array(power)], ["recording", "frame_no", "start_ms", "power"])


class WavFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


class ProbeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.digest = options["path"], options.get("digest", "true") == "true"
        self.low, self.high, self.most = int(options["minms"]), int(options["maxms"]), int(options["maxbytes"])

    def partitions(self) -> list[Spans]:
        """Whole files; without digests only their headers are read."""
        files, parts, held, cost = listed(self.path), [], [], 0
        for url, size in files:
            more = OPEN + (size if self.digest and size <= self.most else 0)
            if held and cost + more > RANGE:
                parts.append(Spans(held))
                held, cost = [], 0
            held.append((url, size, 0, size))
            cost += more
        return [*parts, Spans(held)]  # without a file, one empty range

    def read(self, partition: Spans) -> Iterator[tuple]:
        for url, size, _, _ in partition.spans:
            yield self.facts(url, size)

    def facts(self, url: str, size: int) -> tuple:
        if size > self.most:
            return url, size, None, None, None, None, None, "AUDIO_SIZE_LIMIT"
        with opened(url) as file:
            digest = None
            if self.digest:
                found = hashlib.sha256()
                while block := file.read(CHUNK):
                    found.update(block)
                digest = found.hexdigest()
            try:
                rate, channels, width, _, length = wav_layout(file)
            except ValueError:
                return url, size, digest, None, None, None, None, "AUDIO_PROBE_FAILED" if size else "AUDIO_EMPTY"
        ms = round(1000 * (length // (width * channels)) / rate)
        return url, size, digest, "pcm_u8" if width == 1 else f"pcm_s{8 * width}le", ms, rate, channels, None if self.low <= ms <= self.high else "AUDIO_DURATION_LIMIT"


class WavProbe(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_probe"

    def schema(self) -> str:
        return PROBE

    def reader(self, schema) -> ProbeReader:
        return ProbeReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session with both data sources, and with filters pushed to data sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (WavFrames, WavProbe):
        spark.dataSource.register(source)
    return spark


def probed(spark: SparkSession, path: str, min_ms: int = 400, max_ms: int = 4 * 3600 * 1000, max_bytes: int = 1 << 30, digest: bool = True) -> DataFrame:
    """WAV files' facts from their headers, whatever they are called; error is null for files that may be analysed. Files of over
    max_bytes are not opened. sha256 reads the whole file, block by block; without digest it is null."""
    options = {"minMs": min_ms, "maxMs": max_ms, "maxBytes": max_bytes, "digest": str(digest).lower()}
    return registered(spark).read.format("wav_probe").options(**options).load(path)


def power_frames(spark: SparkSession, path: str, frame_ms: int = 30, rate: int = 16_000, skip_unreadable: bool = False) -> DataFrame:
    """Mean squares of whole frames of WAV files at a rate: recording, frame_no, start_ms, power. What is no WAV file is an error
    or, with skip_unreadable, has no frames (probed() tells which)."""
    options = {"frameMs": frame_ms, "rate": rate, "onError": "skip" if skip_unreadable else "fail"}
    return registered(spark).read.format("wav_frames").options(**options).load(path)


def regions(wanted: DataFrame, rate: int = 16_000) -> DataFrame:
    """Adds pcm (16-bit mono samples at rate) and error to wanted: path, start_ms, end_ms and more columns. Only the region's bytes
    are read, clamped to the file; a file that is no WAV or can't be opened is AUDIO_UNREADABLE and spoils no other."""

    def read(path: str, start_ms: int, end_ms: int) -> bytes:
        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_file(name) as f:
            own, channels, width, at, size = wav_layout(f)
            step, last = width * channels, size // (width * channels)
            a, b = (max(0, min(last, ms * own // 1000)) for ms in (start_ms, end_ms))
            f.seek(at + a * step)
            return samples(f.read(max(0, b - a) * step), width, channels, own, rate).tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for path, a, b in zip(frame["path"], frame["start_ms"], frame["end_ms"], strict=True):
                try:
                    found.append((read(path, int(a), int(b)), None))
                except (OSError, ValueError, pa.ArrowException):
                    found.append((None, "AUDIO_UNREADABLE"))
            yield frame.assign(pcm=[f[0] for f in found], error=[f[1] for f in found])

    kinds = ", ".join(f"`{c}` {t}" for c, t in wanted.dtypes)
    return wanted.mapInPandas(run, f"{kinds}, pcm binary, error string")


def wav_bytes(pcm: bytes, rate: int = 16_000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm)
    return out.getvalue()


def rendered(clips: DataFrame, rate: int = 16_000) -> DataFrame:
    """Each clip (path, start_ms, end_ms and more columns) as a WAV file of its own: content in place of pcm."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content=[None if x is None else wav_bytes(x, rate) for x in frame["pcm"]]).drop(columns="pcm")

    rows = regions(clips, rate)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "pcm")
    return rows.mapInPandas(run, f"{kinds}, content binary")


def pcm_range(samples: Column, start_ms: Column, end_ms: Column, rate: int = 16_000) -> Column:
    """Bytes of 16-bit mono samples between two times, clamped to what there is."""
    size = F.octet_length(samples)
    at = lambda ms: F.least(size, F.greatest(F.lit(0), F.floor(ms * rate / 1000) * 2)).cast("int")
    return F.substring(samples, at(start_ms) + 1, F.greatest(F.lit(0), at(end_ms) - at(start_ms)))
