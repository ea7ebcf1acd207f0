"""Fill-in-the-middle transformation by an indexable skip list.

A text's units (code points, or what a pattern matches from left to right) are the bottom lane of a skip list, LEAF of
them to a node. A node is promoted to the lane above with a chance of one in FAN, by a hash of its place. Every node of
every lane carries two widths: how many units and how many code points lie between it and the next node of its lane. A
cut at a unit's rank is found from the top lane down, by adding up widths as long as they stay below the rank, and comes
out as a code point's place, exactly.

A document is cut at two ranks drawn from the sha256 of `seed:doc_id`, and its parts are put in the order prefix,
suffix, middle (psm), suffix, prefix, middle (spm), or left as they are (plain). Each document is transformed by itself:
no shuffle, and memory for one batch of rows.

Defined cases: a null text counts as empty and is plain; a text that holds a marker is plain, so that outputs can be taken
apart again; a null doc_id is drawn by `seed:`; what a pattern passes over belongs to the unit that follows, and a rest
that it never matches is one unit; repeated rows give repeated results; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM, SEED = 90, 20, "1"
LEAF, FAN = 64, 4
#: Rows of an Arrow batch that are transformed at once.
ROWS = 256
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def promoted(n: int, lane: int) -> np.ndarray:
    """Places of a lane's n nodes that the lane above has, the first always among them."""
    mixed = (np.arange(n, dtype=np.uint64) + np.uint64(1 + (lane << 40))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    chosen = (mixed >> np.uint64(32)) % np.uint64(FAN) == 0
    chosen[:1] = True
    return np.flatnonzero(chosen)


class Units:
    """The units of a text, addressed by rank. lanes: from the bottom up, the nodes' unit widths and code-point widths, and
    where each node stands in the lane below."""

    def __init__(self, text: str, unit: re.Pattern | None = None):
        self.lengths = None if unit is None else self._lengths(text, unit)
        self.n = len(text) if unit is None else len(self.lengths)
        starts = np.arange(0, self.n, LEAF)
        units = np.minimum(self.n - starts, LEAF)
        points = units if unit is None else np.add.reduceat(self.lengths, starts) if self.n else units
        self.lanes = [(units, points, None)]
        while len(units) > FAN:
            down = promoted(len(units), len(self.lanes))
            if len(down) == len(units):
                break
            units, points = np.add.reduceat(units, down), np.add.reduceat(points, down)
            self.lanes.append((units, points, down))

    @staticmethod
    def _lengths(text: str, unit: re.Pattern) -> np.ndarray:
        ends = [0, *(m.end() for m in unit.finditer(text) if m.end() > m.start())]
        if ends[-1] < len(text):
            ends.append(len(text))
        return np.diff(np.array(ends, np.int64))

    def place(self, rank: int) -> int:
        """Code points before the unit of that rank; rank n is the end."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        node = seen = points = 0
        for units, widths, down in reversed(self.lanes):
            while node < len(units) and seen + units[node] <= rank:
                seen += int(units[node])
                points += int(widths[node])
                node += 1
            if seen == rank:
                return points
            if down is not None:
                node = int(down[node])
        rest = rank - seen
        return points + (rest if self.lengths is None else int(self.lengths[node * LEAF : node * LEAF + rest].sum()))


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def arranged(doc_id: int | None, text: str, unit: re.Pattern | None = None, seed: str = SEED) -> tuple:
    """n, form, code points of prefix and middle, output."""
    first, second, chance, order = draws(doc_id, seed)
    units = Units(text, unit)
    if not text or chance % 100 >= RATE or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return units.n, "plain", None, None, text
    low, high = sorted((first % (units.n + 1), second % (units.n + 1)))
    a, b = units.place(low), units.place(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < SPM:
        return units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transformed(docs: DataFrame, unit: str | None = None, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text) rearranged: doc_id, n (units), form, prefix_chars, middle_chars, output. unit: a pattern, or
    code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit) if unit else None
        for batch in batches:
            for rows in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                ids = rows.column(0).to_pylist()
                done = [arranged(k, t or "", pattern, seed) for k, t in zip(ids, rows.column(1).to_pylist(), strict=True)]
                n, form, prefix, middle, output = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Each marker stands in it once, as texts that hold one are plain."""
    between = lambda left, right: F.split_part(F.split_part(output, F.lit(left), F.lit(2)), F.lit(right), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def report(docs: DataFrame) -> DataFrame:
    """Per document, by code points: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    done = transformed(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
