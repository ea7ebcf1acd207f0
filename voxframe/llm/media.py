"""Media columns: archives of members as a Spark data source, and documents stored as images.

`MediaArchive` reads and writes directories of ZIP archives (members stored as they are). The writer rolls to a new
archive at `archiveBytes` and makes archives visible only when the whole write commits. The reader plans byte ranges
of `rangeBytes` over the archives from their sizes alone; a task lists the archive's central directory, takes the
members whose header starts in its range, and streams them as Arrow batches of at most BATCH bytes. Each member is
read and checked by itself at its own offset, and read again at that offset on an error, up to `attempts` times;
after that the task fails, or with `onError=record` the row says why and has no content. A directory is listed again
in the same way; one that stays unreadable is one such row, of the range in which the archive starts. Members stored or
deflated by other writers are read; other compressions are errors. Each write has a pending folder of its own.

A document is stored as a grey-scale PNG image, 64 samples of 8 bits a row: its text as UTF-8, filled with zero bytes
to a positive multiple of 64.

Defined cases: a null or empty text is one row of zeros; a null doc_id comes back as null; repeated rows are members
of their own; an empty table gives an empty result; other columns are never read. A member is held in memory whole.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from voxframe.llm.shared import scratch

BATCH, ROW = 8 << 20, 64
READ = "archive string, offset long, name string, content binary, attempts int, error string"


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list


class Source:
    """Members of one archive."""

    def __init__(self, url: str):
        self.fs, self.path = fs.FileSystem.from_uri(url)
        self.file = None

    def open(self, again: bool = False):
        if self.file is None or again:
            self.file = self.fs.open_input_file(self.path)
        return self.file

    def listing(self, again: bool) -> list[tuple]:
        """(header's offset, end, name, size, CRC, method) by offset, from the central directory."""
        try:
            with zipfile.ZipFile(self.open(again)) as z:
                entries, directory = sorted(z.infolist(), key=lambda e: e.header_offset), z.start_dir
        except (zipfile.BadZipFile, ValueError, struct.error) as e:
            raise OSError(f"no readable directory: {e}") from e
        finally:
            self.file = None
        ends = [e.header_offset for e in entries[1:]] + [directory]
        return [(e.header_offset, end, e.filename, e.compress_size, e.CRC, e.compress_type) for e, end in zip(entries, ends, strict=True)]

    def member(self, start: int, end: int, size: int, crc: int, method: int, again: bool) -> bytes:
        """A member's content by its offset; an error if it isn't what the directory says."""
        file = self.open(again)
        file.seek(start)
        raw = file.read(end - start)
        if len(raw) < 30 or raw[:4] != b"PK\x03\x04":
            raise OSError("no member at this offset")
        name, extra = struct.unpack("<HH", raw[26:30])
        content = raw[30 + name + extra : 30 + name + extra + size]
        if len(content) != size:
            raise OSError("the content ends too early")
        if method == zipfile.ZIP_DEFLATED:
            try:
                content = zlib.decompress(content, -15)
            except zlib.error as e:
                raise OSError(f"the content isn't deflated: {e}") from e
        elif method != zipfile.ZIP_STORED:
            raise OSError(f"compression {method} isn't read")
        if zlib.crc32(content) != crc:
            raise OSError("the content doesn't match its checksum")
        return content


def tried(attempts: int, work) -> tuple:
    """(what work(again) gives, tries, None), or (None, tries, what went wrong at last)."""
    error = None
    for n in range(attempts):
        try:
            return work(n > 0), n + 1, None
        except OSError as e:
            error = f"{type(e).__name__}: {e}"
    return None, attempts, error


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.span = options["path"], int(options.get("rangebytes", 32 << 20))
        self.attempts, self.record = int(options.get("attempts", 3)), options.get("onerror", "fail") == "record"

    def partitions(self) -> list[Range]:
        system, path = fs.FileSystem.from_uri(self.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        files = [f for f in system.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True)) if f.path.endswith(".zip")]
        return [Range(prefix + f.path, at, min(at + self.span, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.span)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        source, rows, held = Source(partition.archive), [], 0
        listed, tries, error = tried(self.attempts, source.listing)
        if listed is None:
            if not self.record:
                raise OSError(f"{partition.archive}: {error}")
            if partition.start == 0:
                yield batch([(partition.archive, None, None, None, tries, error)])
            return
        for start, end, name, size, crc, method in listed:
            if not partition.start <= start < partition.end:
                continue
            content, tries, error = tried(self.attempts, lambda again, of=(start, end, size, crc, method): source.member(*of, again))
            if content is None and not self.record:
                raise OSError(f"{partition.archive} at {start}: {error}")
            rows.append((partition.archive, start, name, content, tries, error))
            held += len(content or b"")
            if held >= BATCH:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "offset", "name", "content", "attempts", "error"])


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("archivebytes", 64 << 20))
        self.pending = f"_pending-{uuid.uuid4().hex}"  # made on the driver, the same in all tasks of this write

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{path}/{self.pending}", recursive=True)
        done, archive, out, size = [], None, None, 0

        def close():
            nonlocal archive, size
            if archive is not None:
                archive.close()
                out.close()
                archive, size = None, 0

        for rows in iterator:
            for name, content in zip(rows.column("name"), rows.column("content"), strict=True):
                if archive is None:
                    done.append(f"{uuid.uuid4().hex}.zip")
                    out = system.open_output_stream(f"{path}/{self.pending}/{done[-1]}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                raw = content.as_py()
                archive.writestr(zipfile.ZipInfo(name.as_py()), raw)
                size += len(raw)
                if size >= self.most:
                    close()
        close()
        return Written(done)

    def commit(self, messages: list) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.archives):
            system.move(f"{path}/{self.pending}/{name}", f"{path}/{name}")
        if system.get_file_info(f"{path}/{self.pending}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.pending}")  # what lost tasks left

    def abort(self, messages: list) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{path}/{self.pending}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.pending}")


class MediaArchive(DataSource):
    """spark.read / df.write with format("media_archive"); writes take the columns name, content."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """payload: a positive multiple of 64 bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line starts with its filter, 0
    lines[:, 1:] = rows
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, width = 8, [], 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, _, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey-scale")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, sum, sum of squares, sum of steps between neighbours in a row, and a histogram of 8 bins."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    wide = x.astype(np.int64)
    steps = int(np.abs(np.diff(wide, axis=1)).sum())
    return f"{len(x)};{int(wide.sum())};{int((wide * wide).sum())};{steps};" + ",".join(map(str, np.bincount((x >> 5).ravel(), minlength=8)))


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\0")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for part in (rows.slice(i, 1024) for i in range(0, rows.num_rows, 1024)):
            names, media = [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                n, payload = padded(text.as_py())
                names.append(f"{'' if doc_id is None else doc_id}_{n}.png")
                media.append(to_png(payload))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], ["name", "content"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FEATURES.split(", ")]
    for rows in batches:
        out = []
        for name, content in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            media = content.as_py()
            payload = from_png(media)
            doc_id, n = name.removesuffix(".png").split("_")
            out.append((int(doc_id) if doc_id else None, int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, path: str) -> DataFrame:
    """Write docs (doc_id, text) as images into archives at path, and read the archives: the columns of READ."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    images = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "name string, content binary")
    images.write.format("media_archive").mode("append").save(path)
    return spark.read.format("media_archive").load(path)


def features(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of docs, from the stored bytes read back: the columns of FEATURES."""
    path = path or scratch(docs.sparkSession, "media")
    return store(docs, path).select("name", "content").mapInArrow(_features, FEATURES)
