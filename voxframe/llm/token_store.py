"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id; its bitmap tells which
ids continue, and level 1 holds the second chunk of those only, and so on. A rank directory (set bits before each
512) turns a place in one level into its place in the next, so any id is found by a few look-ups, without decoding
others. Files are written through Arrow's file systems, wherever the shared folder lies.

File (little-endian): magic, number of documents, ids, levels; documents (8 bytes each: doc_id; a byte each: 1 for
null); their ends in ids (8 bytes each); then per level its length, chunks, bitmap, and rank directory.

Documents are encoded whole, each with an end id, and lie in ascending order of doc_id: a range of doc_ids per task,
sorted in it, in files of at most FILE ids (or one document).

Words are encoded by the tokenizer once and kept, as it never joins what a space or line break parts. Of a word of
letters with ASCII punctuation behind it, both parts are encoded alone, again as the tokenizer parts them.

Defined cases: a null or empty text is its end id alone; a null doc_id comes first; rows of one doc_id are ordered by
text; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import os
import re
import string
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxframe.llm.shared import kept, publish, scratch

MAGIC, CHUNK, BLOCK, FILE = b"IDLEVEL1", 8, 512, 16 << 20
TOKENIZER, END = public_tokenizers.path("word_bpe_49k.json"), 2
KEPT = 500_000


#: The byte-level alphabet: printable characters of Latin-1 stand for themselves, the others for those from 256 on.
_SHIFTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
ALPHABET = {b: chr(256 + k) for k, b in enumerate(_SHIFTED)}
LATIN = "\u024f"
#: A full stop or comma at a word's end that other punctuation may be joined with.
LONE = re.compile(r"[.,] (?<![a-z0-9\xdf-\xf6\xf8-\xff][.,] )")


class Words(dict):
    """Ids of words, encoded when first asked for.

    When many are kept the table becomes the old one, from which those asked for again move on.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__({"": b""})
        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model, {}

    def renew(self) -> None:
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()
            self[""] = b""

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        self[word] = ids = self.encoded(word) if ids is None else ids
        return ids

    def encoded(self, word: str) -> bytes:
        """A word of letters and the ASCII punctuation behind it are parts that the tokenizer never joins. Small Latin letters
        pass its normaliser and splitter unchanged, so the model alone is asked for them, in its byte-level alphabet."""
        if word.isascii() and word.isalpha() and word.islower():
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        stem = word.rstrip(string.punctuation)
        if stem.isalpha() and (stem.isascii() or (max(stem) <= LATIN and unicodedata.is_normalized("NFC", stem))):
            low = stem.lower()
            if low.isalpha():
                if len(stem) < len(word):
                    return self[low] + self[word[len(stem) :]]
                if low != word:
                    return self[low]
                return array("I", [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(ALPHABET))]).tobytes()
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words, self.end = Words(Tokenizer.from_file(path)), struct.pack("<I", end)

    @staticmethod
    def cut(text: str) -> list[str]:
        """Words that are encoded one by one. In Latin-1 texts words are told apart in small letters only, and full stops and
        commas behind letters or digits are words of their own: fewer words are to be kept, and the ids are the same. Texts
        that could hold a special token's string are left as they are."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        if "<|" in text:
            return text.replace("\n", " ").split(" ")
        text = text.lower().replace("\n", " ")
        if not LONE.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ")
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        self.words.renew()
        get = self.words.__getitem__
        return [b"".join(map(get, self.cut(t or ""))) + self.end for t in texts]


def build(doc_ids: list, encoded: list[bytes]) -> bytes:
    """A file's bytes."""
    ids = np.frombuffer(b"".join(encoded), "<u4")
    ends = np.cumsum([len(e) // 4 for e in encoded], dtype="<u8")
    levels, rest = [], ids
    while not levels or len(rest):
        bits = rest >> CHUNK > 0
        packed = np.packbits(bits, bitorder="little")
        ranks = np.concatenate([[0], np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.int64).cumsum()]) if len(bits) else np.zeros(1, np.int64)
        levels.append(struct.pack("<QQQ", len(rest), len(packed), len(ranks)) + (rest & 0xFF).astype(np.uint8).tobytes() + packed.tobytes() + ranks.astype("<u8").tobytes())
        rest = rest[bits] >> CHUNK
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(levels)), known.tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), ends.tobytes(), *levels])


class TokenFile:
    """Random access to a file's ids."""

    def __init__(self, data):
        self.data = data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        n, self.size, depth = struct.unpack_from("<QQQ", data, 8)
        at = 32
        ids, at = np.frombuffer(data, "<i8", n, at), at + 8 * n
        null, at = np.frombuffer(data, np.uint8, n, at), at + n
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.ends, at = np.frombuffer(data, "<u8", n, at).astype(np.int64), at + 8 * n
        self.levels = []
        for _ in range(depth):
            chunks, packed, ranks = struct.unpack_from("<QQQ", data, at)
            at += 24
            self.levels.append((np.frombuffer(data, np.uint8, chunks, at), np.frombuffer(data, np.uint8, packed, at + chunks), np.frombuffer(data, "<u8", ranks, at + chunks + packed)))
            at += chunks + packed + 8 * ranks

    def rank(self, level: int, i: int) -> int:
        """Set bits before i in a level's bitmap."""
        _, bits, ranks = self.levels[level]
        block = i // BLOCK
        low = block * (BLOCK // 8)
        part = np.unpackbits(bits[low : (i + 7) // 8], bitorder="little")[: i - block * BLOCK]
        return int(ranks[block]) + int(part.sum())

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end."""
        out, where, level = np.zeros(end - start, np.uint32), None, 0
        while end > start:
            chunks, bits, _ = self.levels[level]
            values = chunks[start:end].astype(np.uint32) << np.uint32(CHUNK * level)
            if where is None:
                out |= values
            else:
                out[where] |= values
            more = np.unpackbits(bits[start // 8 : (end + 7) // 8], bitorder="little")[start % 8 : start % 8 + end - start].view(bool)
            n = int(more.sum())
            if not n:
                break
            where = np.flatnonzero(more) if where is None else where[more]
            start = self.rank(level, start)
            end, level = start + n, level + 1
        return out

    def token(self, i: int) -> int:
        return int(self.ids(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def open_file(url: str) -> TokenFile:
    system, path = fs.FileSystem.from_uri(url)
    with system.open_input_file(path) as f:
        return TokenFile(f.read_buffer())


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Write docs (doc_id, text) to token files below path. One row per file: part, file, n_docs, n_ids, url."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = TaskContext.get().partitionId(), encoder(tokenizer, end)
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        count, ids, held, size = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal count, ids, held, size
            name = f"part-{part:06d}-{count:05d}.ids"
            pending = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(pending) as out:
                out.write(build(ids, held))
            system.move(pending, f"{folder}/{name}")  # a repeated task replaces the file by an equal one
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([count]), pa.array([len(ids)]), pa.array([size]), pa.array([f"{path}/{name}"])], ["part", "file", "n_docs", "n_ids", "url"])
            count, ids, held, size = count + 1, [], [], 0
            return row

        for batch in batches:
            for rows in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                for doc_id, e in zip(rows.column(0).to_pylist(), whole.encode(rows.column(1).to_pylist()), strict=True):
                    ids.append(doc_id)
                    held.append(e)
                    size += len(e) // 4
                    if size >= FILE:
                        yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return publish(ordered.mapInArrow(run, "part long, file long, n_docs long, n_ids long, url string"), f"{path}-files")


def encoder(path: str, end: int) -> Encoder:
    """One for each Python worker, so that what it keeps serves later tasks, until the worker serves another operator's."""
    return kept(("token_store", path, end), lambda: Encoder(path, end))


def documents(files: DataFrame) -> DataFrame:
    """Per document, read back from the files that write() lists: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = open_file(url)
                starts = np.concatenate([[0], f.ends[:-1]])
                ids = memoryview(f.ids(0, f.size).astype("<u4").tobytes())
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), f.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(starts + base), pa.array(f.ends - starts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row per file: a running sum over a few rows.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = files.select("url", before.alias("base"))
    spread = listed.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame) -> DataFrame:
    """Write docs to a new folder and describe every document from its files."""
    return documents(write(docs, scratch(docs.sparkSession, "ids")))
