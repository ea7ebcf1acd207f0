"""Packing documents into training sequences of several permitted lengths, by variable-capacity best fit.

A document is the ids that a public tokenizer gives for its whole text and one end id. Documents longer than the largest
permitted length are cut into full pieces and a rest, so nothing is dropped or cut off. Pieces go by size, largest
first, into the open bin with the least room that takes them. Where none does, a bin is opened. All permitted lengths
are weighed for it together against what remains to be packed: for each, the bin is filled in thought from the
histogram of remaining sizes, largest fitting size first, and shrunk to the least permitted length that holds this; the
length with the least cost per token wins, the smaller of equals. cost(c) = FIXED + c + c * c / SQUARE covers a
sequence's fixed cost, padding and attention. In the end every bin shrinks to the least permitted length that holds its
contents.

Each task packs the pieces of its own partition in windows of at most WINDOW pieces or BYTES bytes of ids, so memory is
bounded and no source or document is hot. Bins filled to less than FULL, a few of each window and most of small
partitions, are opened again: their pieces are dealt to as few tasks as make full windows, and packed once more. So how
the table is split costs a few bins per window's worth of such pieces. The first packing is written to the shared folder,
so that both parts are of the same one. sequence_id names a bin of one packing; it says nothing about its contents.

Defined cases: a null or empty text is the end id alone; a null doc_id is packed like any other; rows that repeat
are packed as often as they come; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.shared import publish, scratch
from voxframe.llm.token_store import END, TOKENIZER, encoder

LENGTHS = (256, 512, 1024, 2048, 4096)
FIXED, SQUARE = 32, 16384
WINDOW, BYTES = 1 << 15, 32 << 20
FULL = 0.9


def cost(capacity: int) -> float:
    return FIXED + capacity + capacity * capacity / SQUARE


class Remaining:
    """How many pieces of each size are still to be packed."""

    def __init__(self, sizes: list[int]):
        self.counts: dict[int, int] = {}
        for size in sizes:
            self.counts[size] = self.counts.get(size, 0) + 1
        self.mask = sum(1 << size for size in self.counts)  # bit s: pieces of size s remain

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.mask ^= 1 << size

    def fill(self, room: int) -> int:
        """Tokens that a greedy filling of so much room gets."""
        used, limit = 0, room + 1
        while found := self.mask & ((1 << limit) - 1):
            size = found.bit_length() - 1
            n = min(self.counts[size], (room - used) // size)
            used += n * size
            limit = min(size, room - used + 1)
        return used


def opened(size: int, remaining: Remaining, lengths: tuple[int, ...]) -> int:
    """The capacity of a new bin for a piece of this size, by the cost per token that it will hold."""

    def price(capacity: int) -> float:
        used = size + remaining.fill(capacity - size)
        return cost(min(c for c in lengths if c >= used)) / used

    return min((c for c in lengths if c >= size), key=lambda c: (price(c), c))


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> list[tuple[int, int, int]]:
    """(bin, offset in it, final capacity) of each piece; every size is between 1 and the largest length."""
    lengths = tuple(sorted(set(lengths)))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    remaining = Remaining(sizes)
    bins: list[list[int]] = []  # capacity, used
    by_room: dict[int, list[int]] = {}
    mask = 0  # bit r: some bin has room r
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in order:
        size = sizes[i]
        remaining.take(size)
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            held = by_room[room]
            k = held.pop()
            if not held:
                mask ^= 1 << room
        else:
            k, room = len(bins), opened(size, remaining, lengths)
            bins.append([room, 0])
        placed[i] = (k, bins[k][1])
        bins[k][1] += size
        if room := room - size:
            by_room.setdefault(room, []).append(k)
            mask |= 1 << room
    final = [min(c for c in lengths if c >= used) for _, used in bins]
    return [(k, at, final[k]) for k, at in placed]


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, with_ids: bool = True, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, n_tokens, sequence_id, capacity, offset, ids (little-endian unsigned 32-bit)."""
    longest = max(lengths)
    names = ["doc_id", "piece", "n_tokens", "sequence_id", "capacity", "offset", "full", *["ids"] * with_ids]

    def filled(pieces: Iterable[tuple], prefix: str) -> Iterator[pa.RecordBatch]:
        turn = 0

        def flush(rows: list) -> Iterator[pa.RecordBatch]:
            nonlocal turn
            spots = pack([r[2] for r in rows], lengths)
            order = sorted(range(len(rows)), key=lambda i: spots[i][:2])
            base = f"{prefix}{TaskContext.get().partitionId():07d}-{turn:05d}-"
            turn += 1
            used: dict[int, int] = {}
            for r, (k, _, _) in zip(rows, spots, strict=True):
                used[k] = used.get(k, 0) + r[2]
            for at in range(0, len(order), 2048):
                part = [(rows[i], spots[i]) for i in order[at : at + 2048]]
                columns = [pa.array([r[0] for r, _ in part], pa.int64()), pa.array([r[1] for r, _ in part], pa.int32()), pa.array([r[2] for r, _ in part], pa.int32()), pa.array([base + f"{s[0]:06d}" for _, s in part]), pa.array([s[2] for _, s in part], pa.int32()), pa.array([s[1] for _, s in part], pa.int32()), pa.array([used[s[0]] >= FULL * s[2] for _, s in part])]
                if with_ids:
                    columns.append(pa.array([r[3] for r, _ in part], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

        rows, held = [], 0
        for piece in pieces:
            rows.append(piece)
            held += len(piece[3])
            if len(rows) >= WINDOW or held >= BYTES:
                yield from flush(rows)
                rows, held = [], 0
        if rows:
            yield from flush(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[tuple]:
            whole = encoder(tokenizer, end)
            for batch in batches:
                for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                    for doc_id, ids in zip(part.column(0).to_pylist(), whole.encode(part.column(1).to_pylist()), strict=True):
                        for k, at in enumerate(range(0, len(ids), 4 * longest)):
                            piece = ids[at : at + 4 * longest]
                            yield doc_id, k, len(piece) // 4, piece if with_ids else b""

        return filled(cut(), "")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for batch in batches:
                ids = batch.column(3).to_pylist() if with_ids else [b""] * batch.num_rows
                yield from zip(*[batch.column(k).to_pylist() for k in range(3)], ids, strict=True)

        return filled(read(), "r")

    kind = "doc_id long, piece int, n_tokens int, sequence_id string, capacity int, offset int, full boolean" + ", ids binary" * with_ids
    first = publish(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind), scratch(docs.sparkSession, "packed"))
    rest = first.filter("not full")
    n, size = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0)) * (4 * with_ids)).first()
    tasks = max(1, -(-n // WINDOW), -(-size // BYTES))
    rest = rest.select("doc_id", "piece", "n_tokens", *["ids"] * with_ids).repartition(tasks).mapInArrow(again, kind)
    return first.filter("full").unionByName(rest).drop("full")


def sequences(rows: DataFrame) -> DataFrame:
    """Per sequence of packed(): its capacity, tokens and pieces in order; a sequence is bounded by the largest length."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "n_tokens", "ids")))
    return rows.groupBy("sequence_id", "capacity").agg(F.sum("n_tokens").alias("n_tokens"), held.alias("pieces"))
