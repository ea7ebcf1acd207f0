"""Document fingerprints by one-permutation MinHash.

Shingles of WIDTH words are hashed once; the top bits of a hash choose one of BINS bins, and each bin keeps its least
hash. An empty bin takes the hash of a filled one by optimal densification: every bin has its own endless universal
sequence of bins, and the first filled bin in it is taken, so two sets with the same filled bins choose alike and a
choice says nothing about others. Of each bin's hash, mixed with the bin's number so that copies of one hash agree with
those of another by chance only bin by bin, the lowest BITS bits are stored, packed. Two fingerprints agree in a bin by
chance with probability 2**-BITS, so their likeness is (agreement - 2**-BITS) / (1 - 2**-BITS), held between 0 and 1:
an unbiased estimate of the sets' Jaccard similarity with a standard error of about 0.016 for BINS = 1024.

Words are runs of characters other than space and \\x09-\\x0D, with A-Z in lower case. A text is hashed in blocks of bytes
cut between words, with the last words carried over, so its length costs no memory beyond itself.

Documents are paired with the next one in parts of the order of doc_id, sorted within; bounds come from a sample of keys
(SAMPLE a part), and the first row of each part is sent to the part before as well. Texts are shuffled once.

Defined cases: a text of fewer words than WIDTH is one shingle; one without words, or null, has the empty fingerprint,
which is like itself (1) and nothing else (0); equal texts have equal fingerprints; a null doc_id comes first; rows
of one doc_id are ordered by their texts' hash, and of one text by their place; a single document is its own next; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, BINS, BITS = 5, 1024, 4
BLOCK, ROUND, ROWS, SAMPLE = 1 << 18, 16, 256, 50
EMPTY = np.uint64(2**64 - 1)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_VALUE = np.where(_SPACE, np.uint64(0), mixed(np.frombuffer(_LOWER, np.uint8).astype(np.uint64) + np.uint64(1)))


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    size = BLOCK + 1
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def words(block: np.ndarray) -> np.ndarray:
    """Hashes of the words of a block: polynomials in their bytes, wherever they stand."""
    space = _SPACE[block]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers()
    return mixed(np.add.reduceat(_VALUE[block] * up[: len(block)], starts) * down[starts])


def blocks(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of a text's words, block by block. A word longer than a block is hashed by itself."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at : end + 1]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(data) and not _SPACE[data[end]]:
                    found = np.flatnonzero(_SPACE[data[end : end + BLOCK]])
                    end += int(found[0]) if len(found) else min(BLOCK, len(data) - end)
                digest = hashlib.blake2b(text[at:end].translate(_LOWER), digest_size=8).digest()
                yield np.frombuffer(digest, "<u8").astype(np.uint64)
                at = end
                continue
        yield words(data[at:end])
        at = end


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(_BASE) + words[k : k + len(total)]
    return mixed(total + np.uint64(width))


def minima(text: bytes, width: int = WIDTH, bins: int = BINS) -> np.ndarray:
    """The least hash of each bin; EMPTY where there is none."""
    least, carried, n = np.full(bins, EMPTY), np.empty(0, np.uint64), 0
    shift = np.uint64(64 - (bins.bit_length() - 1))
    for found in blocks(text):
        n += len(found)
        held = np.concatenate([carried, found]) if len(carried) else found
        if len(held) >= width:
            hashes = shingles(held, width)
            np.minimum.at(least, hashes >> shift, hashes)
        carried = held[-(width - 1) :] if width > 1 else held[:0]
    if 0 < n < width:
        hashes = shingles(carried, n)
        np.minimum.at(least, hashes >> shift, hashes)
    return least


@functools.lru_cache(1024)
def tries(k: int, bins: int) -> np.ndarray:
    """Members ROUND * k and following of every bin's sequence of bins."""
    at = np.arange(ROUND * k, ROUND * (k + 1), dtype=np.uint64)[:, None] * np.uint64(bins) + np.arange(bins, dtype=np.uint64)
    return (mixed(at * np.uint64(_BASE) + np.uint64(7)) >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int32)


def densified(least: np.ndarray) -> np.ndarray:
    """Hashes of all bins, of which one at least is filled."""
    filled = least != EMPTY
    if filled.sum() == 1:
        return np.full(len(least), least[filled][0])
    source, empty, k = np.arange(len(least)), np.flatnonzero(~filled), 0
    while len(empty):
        there = tries(k, len(least))[:, empty]
        hit = filled[there]
        done = hit.any(axis=0)
        source[empty[done]] = there[hit.argmax(axis=0)[done], np.flatnonzero(done)]
        empty, k = empty[~done], k + 1
    return least[source]


def fingerprint(text: str | bytes, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> bytes:
    """Packed low bits of all bins, the first bin in the highest bits of the first byte; empty for a text without words.
    bins is a power of two, bits at most 8."""
    least = minima(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text, width, bins)
    if (least == EMPTY).all():
        return b""
    own = mixed(densified(least) + np.arange(bins, dtype=np.uint64) * np.uint64(_BASE))
    low = (own & np.uint64(2**bits - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits :]).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of what two fingerprints stand for."""
    if not a or not b:
        return float(a == b)
    apart = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, bits).any(axis=1)
    chance = 2.0**-bits
    return min(1.0, max(0.0, (1 - apart.mean() - chance) / (1 - chance)))


def alike(a: Column, b: Column, bits: int = BITS) -> Column:
    """Likeness of two columns of fingerprints; null where one is null."""

    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else likeness(x, y, bits) for x, y in zip(left, right, strict=True)], dtype="float64")

    return of(a, b)


def fingerprints(docs: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id and fingerprint (binary) of every row of docs (doc_id, text), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                made = [fingerprint(t or "", width, bins, bits) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(made, pa.binary())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint binary")


def edited(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by as many code points of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(doc_id: int | None, text: str, own: bytes, following: str, other: bytes) -> tuple:
    """A document's row of RESULT."""
    changed = edited(text, following).encode("utf-8", "surrogatepass")
    made = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), own, made, likeness(own, made), likeness(own, other)


def with_next(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text) with the fingerprints of its text and of its text edited by the next document's, in
    ascending order of doc_id, the first following the last: the columns of RESULT.

    docs is read three times, twice for its keys alone, and must give the same rows each time, as a table does.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A third of all rows may have one doc_id, or none: their texts' hashes and, of one text, their places tell them apart.
    rows = rows.select("doc_id", "text", F.col("doc_id").isNotNull().cast("int").alias("named"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    key = ["named", "id", "hash", "place"]
    n = docs.count()
    sample = sorted(map(tuple, rows.select(*key).sample(min(1.0, SAMPLE * parts / max(n, 1)), seed=1).collect()))
    bounds = [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []

    @F.pandas_udf("int")
    def part(named: pd.Series, id: pd.Series, hash: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, k) for k in zip(named.tolist(), id.tolist(), hash.tolist(), place.tolist(), strict=True)], dtype="int32")

    dealt = rows.withColumn("part", part(*key))
    heads = sorted((r["part"], tuple(r["head"])) for r in dealt.groupBy("part").agg(F.min(F.struct(*key)).alias("head")).collect())
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def parts_of(part: pd.Series, named: pd.Series, id: pd.Series, hash: pd.Series, place: pd.Series) -> pd.Series:
        keys = zip(named.tolist(), id.tolist(), hash.tolist(), place.tolist(), strict=True)
        return pd.Series([[p, before[k]] if k in before else [p] for p, k in zip(part.tolist(), keys, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for some in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                out = []
                for doc_id, text, ahead in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    own = fingerprint(text)
                    if held:
                        out.append(compared(*held, text, own))
                    held = None if ahead else (doc_id, text, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if held:
            raise ValueError("docs gave other rows when read again")

    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    # The first row of each part also goes to the part before, behind its last row.
    sent = dealt.select("doc_id", "text", *key, F.posexplode(parts_of("part", *key)).alias("ahead", "to")).repartitionById(parts, F.col("to"))
    return sent.sortWithinPartitions("ahead", *key).select("doc_id", "text", "ahead").mapInArrow(run, RESULT)


def report(docs: DataFrame) -> DataFrame:
    """with_next, fingerprints as hexadecimal strings: with BITS = 4, a digit for each bin."""
    made = with_next(docs)
    return made.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
