"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages (runs of 64 words). Every passage of the whole text is encoded from 16 measures of its
bytes and words, and from the words themselves (their shares in SLOTS hash slots); a gated attention learned from document labels weighs the encodings, and the weighted sum is scored:

    h_k = relu(x_k W + b),  a = softmax_k(w . (tanh(h_k V) * sigmoid(h_k U))),  score = sigmoid(c . sum_k a_k h_k + c0)

The model is fitted on the driver on a bounded sample: at most SAMPLE labelled documents of each class, those with the
least hash of doc_id. Only the measures of their passages reach the driver. Labels are learned only from rows whose
crc32(doc_id as text) mod 4 is not 2. lang, source and doc_id are no inputs of a score.

Defined cases: a null text counts as empty; an empty text is a bag of one passage without words; a null doc_id is not
held out; labels that are null or without a document are ignored; with no labels of one class every score is the
share of label 1 (0.5 without labels); rows that repeat get equal scores; an empty table gives an empty result.
Texts of over PART bytes are measured part by part; a part ends where a passage does, so passages don't depend on PART.
For the fit a document gives at most PASSAGES of its passages, evenly spaced, and a doc_id one row; scores use all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.shared import kept

WORDS, PART, SAMPLE, PASSAGES, THRESHOLD = 64, 1 << 20, 2000, 512, 0.7
HIDDEN, ATTENTION, STEPS, RATE, DECAY, SEED = 16, 8, 300, 0.02, 1e-3, 7
SPACE, LOWER, UPPER, DIGIT, SYMBOL, BAR, CALL, POINT, OTHER = range(9)
N_MEASURES, SLOTS = 16, 16
N_FEATURES = N_MEASURES + SLOTS


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[:128] = POINT
    for c in range(128):
        ch = chr(c)
        table[c] = SPACE if c == 32 or 9 <= c <= 13 else LOWER if ch.islower() else UPPER if ch.isupper() else DIGIT if ch.isdigit() else SYMBOL if ch in "#$%&*@^~_=+<>\\" else BAR if ch == "|" else CALL if ch == "!" else POINT
    return table


CLASS = _classes()
_RNG = np.random.default_rng(11)
BYTE = np.where(CLASS == SPACE, np.uint64(0), _RNG.integers(1, 2**63, 256, np.uint64))
PLACE = _RNG.integers(1, 2**63, 64, np.uint64) | np.uint64(1)


def measures(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of several texts and their bounds -> (passages x features, index of the text of each passage)."""
    n_texts = len(bounds) - 1
    kind = CLASS[data]
    solid = kind != SPACE
    before = np.empty_like(solid)
    before[1:], before[:1] = solid[:-1], False
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        return np.zeros((n_texts, N_FEATURES), np.float32), np.arange(n_texts)
    after = np.empty_like(solid)
    after[:-1], after[-1:] = solid[1:], False
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    length = (ends - starts).astype(np.float64)
    text = np.searchsorted(bounds, starts, "right") - 1
    first = np.searchsorted(text, np.arange(n_texts))
    fresh = (np.arange(len(starts)) - first[text]) % WORDS == 0
    passage = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(starts)) - 1
    n = (tails - heads + 1).astype(np.float64)

    spot = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if spot is None:
        spot = np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))])
    word = np.add.reduceat(BYTE[data] * PLACE[spot & 63], starts)

    counts = []
    per_word = {}
    for k in (UPPER, LOWER, DIGIT, SYMBOL, BAR, CALL, POINT, OTHER):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        counts.append(total[ends[tails]] - total[starts[heads]])
        if k in (UPPER, LOWER):
            per_word[k] = total[ends] - total[starts]
    size = np.add.reduceat(length, heads)
    shares = [c / size for c in (counts[0], *counts[2:])]
    again = np.concatenate([[False], (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])])
    key = np.sort((passage.astype(np.uint64) << np.uint64(36)) | (word >> np.uint64(28)))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    distinct = np.bincount((key[new] >> np.uint64(36)).astype(np.int64), minlength=len(heads))
    last = kind[ends - 1]
    mean = size / n
    spread = np.sqrt(np.maximum(0, np.add.reduceat(length**2, heads) / n - mean**2))
    each = lambda flags: np.add.reduceat(flags.astype(np.float64), heads) / n
    x = np.stack([np.log1p(n) / 5, mean / 10, spread / 10, *shares, each(again), 1 - distinct / n, each(last == SYMBOL), each(last == CALL), each((per_word[UPPER] > 1) & (per_word[LOWER] == 0)), each((length == 1) & (last == BAR))], axis=1)
    slot = np.bincount(passage * SLOTS + (word >> np.uint64(60)).astype(np.int64), minlength=len(heads) * SLOTS).reshape(-1, SLOTS)
    x = np.concatenate([x, slot / n[:, None]], axis=1)
    bags = text[heads]
    empty = np.setdiff1d(np.arange(n_texts), bags)
    x, bags = np.concatenate([x, np.zeros((len(empty), x.shape[1]))]), np.concatenate([bags, empty])
    order = np.argsort(bags, kind="stable")
    return x[order].astype(np.float32), bags[order]


def passages(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, index of the text) of the texts in groups; a text's passages are never parted between groups."""
    kept("quality", tuple)  # nothing; what another operator has left would stand beside the features
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, "right")) - 1)
        low, high = offsets[at], offsets[to]
        if high - low <= PART:
            x, bags = measures(data[low:high], offsets[at : to + 1] - low)
        else:  # one long text
            parts, start, room = [], low, PART
            while start < high:
                end = min(high, start + room)
                if end < high:
                    solid = CLASS[data[start : end + 1]] != SPACE
                    words = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
                    whole = (len(words) - 1) // WORDS * WORDS  # the last word may go on
                    if whole <= 0:
                        room *= 2
                        continue
                    end = start + int(words[whole])
                if end < high or (CLASS[data[start:end]] != SPACE).any() or not parts:
                    parts.append(measures(data[start:end], np.array([0, end - start]))[0])
                start, room = end, PART
            x = np.concatenate(parts)
            bags = np.zeros(len(x), np.int64)
        yield x, bags + at
        at = to


def _bags(bags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], bags[1:] != bags[:-1]]))


def forward(model: dict, x: np.ndarray, bags: np.ndarray) -> dict:
    """bags must be sorted and name every bag."""
    x = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    pre = x @ model["W"] + model["b"]
    h = np.maximum(pre, 0)
    t, s = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    e = (t * s) @ model["w"]
    heads = _bags(bags)
    group = np.cumsum(np.concatenate([[0], bags[1:] != bags[:-1]]))
    e = np.exp(e - np.maximum.reduceat(e, heads)[group])
    a = e / np.add.reduceat(e, heads)[group]
    z = np.add.reduceat(a[:, None] * h, heads)
    return {"x": x, "pre": pre, "h": h, "t": t, "s": s, "a": a, "z": z, "heads": heads, "group": group, "p": 1 / (1 + np.exp(-np.clip(z @ model["c"] + model["c0"], -30, 30)))}


def gradients(model: dict, x: np.ndarray, bags: np.ndarray, labels: np.ndarray) -> dict:
    """Of the mean logarithmic loss, by parameter."""
    f = forward(model, x, bags)
    d = (f["p"] - labels) / len(labels)
    g = {"c": f["z"].T @ d, "c0": d.sum(keepdims=True)}
    dz = (d[:, None] * model["c"])[f["group"]]
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["heads"])[f["group"]])
    gate = f["t"] * f["s"]
    g["w"] = gate.T @ de
    dg = de[:, None] * model["w"]
    dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * gate * (1 - f["s"])
    g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
    dh = dz * f["a"][:, None] + dt @ model["V"].T + ds @ model["U"].T
    dh *= f["pre"] > 0
    g["W"], g["b"] = f["x"].T @ dh, dh.sum(axis=0)
    return g


def start(x: np.ndarray) -> dict:
    """A model to begin with, for passages of x's width and spread."""
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    return {"mean": mean, "scale": scale, "W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "c0": np.zeros(1)}


def fit(x: np.ndarray, bags: np.ndarray, labels: np.ndarray) -> dict:
    """Full-batch Adam on the logarithmic loss; labels by bag."""
    model, names = start(x), ("W", "b", "V", "U", "w", "c", "c0")
    m, v = ({k: np.zeros_like(model[k]) for k in names} for _ in range(2))
    for step in range(1, STEPS + 1):
        g = gradients(model, x, bags, labels)
        for k in names:
            grad = g[k] + DECAY * model[k] * (k not in ("b", "c0"))
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            model[k] = model[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out():
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model; labels has doc_id and quality."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, bags in passages(batch.column(1)):
                heads = np.append(_bags(bags), len(bags))
                spread = [x[i + np.arange(min(j - i, PASSAGES)) * (j - i) // min(j - i, PASSAGES)].tobytes() for i, j in zip(heads[:-1], heads[1:], strict=True)]
                of = pa.array(bags[heads[:-1]])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), pa.array(spread, pa.binary())], ["doc_id", "quality", "x"])

    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality")).dropDuplicates(["doc_id"])
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.filter("quality = 1").orderBy(*order).limit(SAMPLE).union(known.filter("quality = 0").orderBy(*order).limit(SAMPLE))
    # At most 2 * SAMPLE rows of two numbers are broadcast.
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    rows = known.mapInArrow(featured, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).orderBy("doc_id").select("r.*").collect()
    y = np.array([r.quality for r in rows], float)
    if len(set(y)) < 2:
        return {"share": float(y.mean()) if len(y) else 0.5}
    parts = [np.frombuffer(bytes(r.x), np.float32).reshape(-1, N_FEATURES) for r in rows]
    return fit(np.concatenate(parts).astype(float), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), y)


def scorer(model: dict):
    """The score of each text, as an Arrow function."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if "share" in model:
            return pa.array(np.full(len(texts), model["share"]))
        out = np.empty(len(texts))
        for x, bags in passages(texts):
            out[bags[_bags(bags)]] = forward(model, x.astype(float), bags)["p"]
        return pa.array(out)

    return score


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""
    score = scorer(train(docs, labels))
    out = docs.select(F.col("doc_id"), held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches THRESHOLD, with all their columns."""
    return docs.filter(scorer(train(docs, labels))(docs["text"]) >= THRESHOLD)
