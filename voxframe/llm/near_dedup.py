"""Near-duplicate detection: MinHash with banding, signature verification, exact confirmation, connected components.

A document's words are the runs of `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; its set holds the distinct runs
of `width` adjacent words. Two documents are linked when 100 * |A and B| >= `percent` * |A or B|.

1. Each text becomes a sorted array of 64-bit shingle hashes; documents with equal arrays form one class, whose
   identifier is its smallest doc_id. Only one document per class goes on, so thousands of copies cost one row.
2. ROWS * BANDS universal hash functions a * x + b mod 2^32 give as many minima; each band of ROWS minima is a bucket.
3. In each bucket the member that shares most buckets with others is the centre, and only pairs with the centre are
   candidates: as many as members, not as their square. Signatures discard what can't reach the threshold, and the
   full sets confirm the rest.
4. Alternating large-star and small-star gives components.
5. A bucket whose members lie in several components may still hide a link between two that are no centre. All nodes
   of such buckets are joined exactly, across components. With t the threshold, two linked sets share one of the
   rarest (1 - t) * n + 1 shingles of the larger (it looks up) with the rarest (1 - 2t / (1 + t)) * n + 1 of the smaller
   (it is found). The second is so short that in documents of one template, which are too unlike to be linked, it holds
   none of the template's shingles. The join's key is the shingle and the band of the found set's size; a match at
   places i and j allows at most min(n_a - i, n_b - j) common shingles, which drops what can't reach the threshold
   inside the join. Shingles with many found sets are split by salt. So groups of near-duplicates of any size need no
   pairs, and no link between members of a bucket is lost.

At the threshold a pair shares a bucket with probability 1 - (1 - 0.8^7)^56 = 1 - 2e-6.

Defined cases: a text without words (or null) has an empty set, n_shingles 0 and no link; with fewer words than
`width` the whole sequence is its one shingle; rows with a null doc_id get component_id null and stay; rows that
repeat a doc_id count as one document and get equal answers; an empty table gives an empty result; other columns
are never read. Texts of any length are hashed in tiles of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.shared import kept, publish, remove, scratch

ROWS, BANDS, SEED = 7, 56, 20240229
TILE = 2048
#: A pair at the threshold agrees in fewer than this share of ROWS * BANDS minima with probability 1e-9.
SLACK = 0.12
#: Shingles are ranked by a table of so many counters; the ranking's quality, not the result, depends on it.
SLOTS = 1 << 20
#: Sets found by one shingle that a task looks through.
HOT = 1000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd multipliers for mixing 64-bit words.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes.split() parts at [\x20\x09-\x0D]
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(kept("near_dedup", Words).__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    mixed = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        mixed = (mixed ^ h[k : k + n]) * MIX[0]
        mixed ^= mixed >> np.uint64(29)
        mixed *= MIX[1]
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    k = ROWS * BANDS
    return (rng.integers(0, 2**32, k, np.uint32) | np.uint32(1))[:, None], rng.integers(0, 2**32, k, np.uint32)[:, None]


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least a * x + b mod 2^32 of each hash function over the set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    room = np.empty((len(a), min(len(x), TILE)), np.uint32)
    for at in range(0, len(x), TILE):
        part = x[at : at + TILE]
        tile = room[:, : len(part)]
        np.multiply(a, part, out=tile)
        np.add(tile, b, out=tile)
        np.minimum(least, tile.min(axis=1), out=least)
    return least


def buckets(least: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX[2]
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * MIX[0]
        key ^= key >> np.uint64(31)
        key *= MIX[1]
        key ^= key >> np.uint64(30)
    return key.view(np.int64)


def signed(width: int):
    """Arrow batches (doc_id, text) -> doc_id, n_shingles, set_key, signature (the low byte of each minimum), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients()
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                ids, texts = part.column(0), part.column(1)
                size, keys, signatures, bands, offsets = [], [], [], [], [0]
                for text in texts:
                    s = shingles(text.as_py(), width)
                    size.append(len(s))
                    if len(s):
                        least = minima(s, a, b)
                        keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                        signatures.append((least & np.uint32(255)).astype(np.uint8).tobytes())
                        bands.append(buckets(least))
                    else:
                        keys.append(None)
                        signatures.append(None)
                    offsets.append(offsets[-1] + BANDS * bool(len(s)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), lists], ["doc_id", "n_shingles", "set_key", "signature", "bands"])

    return run


def sets(width: int):
    """Arrow batches (node, text) -> node, members: the full set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), width).tobytes() for t in part.column(1)], pa.large_binary())], ["node", "members"])

    return run


def alike(percent: int):
    """Pairs with both signatures -> those whose estimate doesn't rule out the threshold."""
    least = max(0.0, percent / 100 - SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, ROWS * BANDS) for c in (2, 3))
            yield batch.filter(pa.array((x == y).mean(axis=1) >= least)).select([0, 1])

    return run


def linked(percent: int):
    """Pairs with both full sets -> those with 100 * |A and B| >= percent * |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) and len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(members) -> slot, n: how many shingles fall in each slot."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            x = np.concatenate([np.frombuffer(m.as_buffer(), np.uint64) for m in part.column(0)])
            total += np.bincount((x % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    slots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])


def prefixes(percent: int, often: np.ndarray):
    """(node, component, members) -> shingle, node, component, n, place, found: the rarest shingles of each set that others
    may have; found: it may be the smaller set's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                out = []
                for node, component, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    x = np.frombuffer(x.as_buffer(), np.uint64)
                    n = often[(x % np.uint64(SLOTS)).astype(np.int64)]
                    order = np.lexsort((x, n))[: len(x) - -(-percent * len(x) // 100) + 1]
                    place = np.flatnonzero(n[order] > 1)  # a slot used once is no other set's
                    short = len(x) - -(-2 * percent * len(x) // (100 + percent)) + 1
                    out.append((x[order[place]].view(np.int64), np.full(len(place), node), np.full(len(place), component), np.full(len(place), len(x)), place, place < short))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["shingle", "node", "component", "n", "place", "found"])

    return run


def exact_candidates(nodes: DataFrame, percent: int, work: str) -> DataFrame:
    """Pairs (u, v) of nodes (node, component, members) of different components that may be linked; none that is linked is missing."""
    # At most SLOTS rows of two numbers reach the driver, and as many counters each task.
    often = np.zeros(SLOTS, np.int64)
    for r in nodes.select("members").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        often[r.slot] = r.n
    kind = "shingle long, node long, component long, n long, place long, found boolean"
    rows = publish(nodes.select("node", "component", "members").mapInArrow(prefixes(percent, np.minimum(often, 2**31 - 1).astype(np.int32)), kind), f"{work}/prefixes")
    # Linked sets' sizes differ by the threshold at most, so the smaller one's band is the larger one's or the next below.
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent)))).cast("int")
    found = rows.filter("found").select("shingle", band.alias("band"), *[F.col(c).alias(f"{c}_v") for c in ("node", "component", "n", "place")])
    looking = rows.select("shingle", F.explode(F.array(band, band - 1)).alias("band"), *[F.col(c).alias(f"{c}_u") for c in ("node", "component", "n", "place")])
    hot = publish(found.groupBy("shingle", "band").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > HOT).select("shingle", "band", F.ceil(F.col("k") / HOT).cast("int").alias("parts")), f"{work}/hot")
    key, parts = ["shingle", "band"], F.coalesce("parts", F.lit(1))
    found = found.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64("node_v"), parts).cast("int")).drop("parts")
    looking = looking.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    both = F.least(F.col("n_u") - F.col("place_u"), F.col("n_v") - F.col("place_v"))
    smaller = (F.col("n_v") < F.col("n_u")) | ((F.col("n_v") == F.col("n_u")) & (F.col("node_v") < F.col("node_u")))
    fits = smaller & (both * (100 + percent) >= percent * (F.col("n_u") + F.col("n_v"))) & (F.col("component_u") != F.col("component_v"))
    pairs = looking.join(found, [*key, "salt"]).filter(fits)
    return pairs.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct()


def components(edges: DataFrame, work: str) -> DataFrame:
    """node, component (the least node reachable) for every node of edges (u, v), by large-star and small-star in turn."""
    spark = edges.sparkSession

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = publish(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), f"{work}/star0")
    known, step = state(now), 0
    while known[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = publish(large, f"{work}/large{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        step += 1
        after = publish(small, f"{work}/star{step}")
        remove(spark, f"{work}/large{step - 1}", f"{work}/star{step - 1}")
        now, before, known = after, known, state(after)
        if known == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    work, out_path = scratch(spark, "near"), scratch(spark, "near-out")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = publish(docs.mapInArrow(signed(width), "doc_id long, n_shingles long, set_key binary, signature binary, bands array<bigint>"), f"{work}/rows")
    classes = publish(rows.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node")), f"{work}/classes")
    chosen = rows.join(classes, "set_key").filter("doc_id = node")
    banded = chosen.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = publish(banded.join(shared, "bucket"), f"{work}/members")
    reach = members.groupBy("node").agg(F.sum(F.col("size") - 1).alias("reach"))
    best = members.join(reach, "node").groupBy("bucket").agg(F.max(F.struct("reach", (-F.col("node")).alias("less"))).alias("best")).select("bucket", (-F.col("best.less")).alias("centre"))
    pairs = members.join(best, "bucket").filter("node <> centre").select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct()
    pairs = publish(pairs, f"{work}/pairs")
    nodes = members.select("node").distinct()
    full = publish(docs.withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi").select("node", "text").mapInArrow(sets(width), "node long, members binary").dropDuplicates(["node", "members"]), f"{work}/sets")
    signatures = chosen.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("signature").alias("of"))

    def both_sides(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        for k in ("u", "v"):
            pairs = pairs.join(table.select(F.col("node").alias(k), F.col(value).alias(f"of_{k}")), k)
        return pairs.select("u", "v", "of_u", "of_v")

    likely = both_sides(pairs, signatures, "of").mapInArrow(alike(percent), "u long, v long")
    links = publish(both_sides(publish(likely, f"{work}/likely"), full, "members").mapInArrow(linked(percent), "u long, v long"), f"{work}/links")
    joined = publish(components(links, f"{work}/stars"), f"{work}/joined")

    # Pairs of two members are tested; of larger buckets those are settled whose members are one component.
    seen = members.filter("size > 2").join(joined, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    open_ = seen.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    rest = publish(seen.join(open_, "bucket", "left_semi").select("node", "component").distinct().join(full, "node"), f"{work}/rest")
    if not rest.isEmpty():
        more = publish(exact_candidates(rest, percent, f"{work}/exact"), f"{work}/more")
        found = publish(both_sides(more, full, "members").mapInArrow(linked(percent), "u long, v long"), f"{work}/found")
        if not found.isEmpty():
            edges = found.union(joined.filter("node <> component").select("node", "component"))
            joined = publish(components(edges, f"{work}/stars-again"), f"{work}/joined-again")
    answer = rows.select("doc_id", "n_shingles", "set_key").join(classes.join(joined, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id")), "set_key", "left")
    answer = answer.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    out = publish(answer.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), out_path)
    remove(spark, work)
    return out


def survivors(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one per component stays, with all their columns; rows without a doc_id stay."""
    gone = near_duplicates(docs, width, percent).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
