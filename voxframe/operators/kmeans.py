"""Spherical k-means of recordings of any size, all at once, and the choice of k.

A recording's unit vectors lie in blocks of about BLOCK, written once. Every pass joins a recording's few numbers (its
candidates or centres) to its blocks, so all tasks share a long recording, and gives sums per block, of which a
recording's are added up. Nothing about recordings passes through the driver but whether any is left.

Beginnings are found by oversampling: ROUNDS times every vector is drawn with a chance in proportion to its weight and
distance from those drawn so far, OVER * k of a recording in the mean; the draws, weighted by the vectors that they are nearest to,
are clustered by themselves (clusters.spherical_kmeans, the best of 20 starts), and their centres are the beginnings.
Then all vectors are assigned and centres moved until none moves; a recording that has settled takes no part in further
passes. A centre that loses all its vectors begins anew at the worst placed one. Draws are by hash of vec_id, so
results are the same on every run and for every partitioning, but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators import clusters
from voxframe.operators.intervals import KEY
from voxframe.params import Clusters
from voxframe.shared import publish, scratch

BLOCK, ROUNDS, OVER = 1024, 5, 4
STILL = 1e-9
VECTORS = "array<array<double>>"
SUMS = "k int, label int, total array<double>, n long, cost double, cos double, weight double, first long"


def blocks(vectors: DataFrame) -> DataFrame:
    """Usable vectors by recording and block: recording_id, block, ids, w (at least 0.001), weight, u. Vectors of a recording are of
    one dimension."""
    rows = clusters.usable(vectors).select(KEY, F.col("vec_id").cast("long").alias("vec_id"), F.col("weight").cast("double").alias("weight"), "u")
    sizes = rows.groupBy(KEY).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    dealt = rows.join(sizes, KEY).withColumn("block", F.pmod(F.xxhash64("vec_id"), "n_blocks").cast("int"))
    held = dealt.groupBy(KEY, "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "weight", "u"))).alias("a"))
    of = lambda name: F.transform("a", lambda x: x[name])
    return publish(held.select(KEY, "block", of("vec_id").alias("ids"), of("weight").alias("weight"), of("u").alias("u")), scratch(vectors.sparkSession, "kmeans"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row, ids, weights, unit vectors) of each block."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            ids, weight = (np.asarray(row.column(c)[0].values) for c in ("ids", "weight"))
            yield row, ids, weight, np.asarray(row.column("u")[0].values.flatten()).reshape(len(ids), -1)


def _matrix(scalar: pa.Scalar) -> np.ndarray:
    return np.array(scalar.as_py(), float)


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 by hash of ids."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0xD1B54A32D192ED03 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64


def candidates(held: DataFrame, most: int) -> DataFrame:
    """recording_id, drawn (vectors), mass (the weight of what is nearest to each)."""
    kind = dict(held.dtypes)[KEY]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, weight, x in _rows(batches):
            best = int(np.lexsort((ids, -weight))[0])
            yield pa.RecordBatch.from_arrays([row.column(KEY), pa.array([float(weight[best])]), pa.array([-int(ids[best])]), pa.array([x[best].tolist()])], [KEY, "weight", "id", "u"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, weight, x in _rows(batches):
            gap = np.maximum(0, 1 - (x @ _matrix(row.column("drawn")[0]).T).max(axis=1)) * np.maximum(0.001, weight)
            yield pa.RecordBatch.from_arrays([row.column(KEY), pa.array([float(gap.sum())])], [KEY, "far"])

    def more(salt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, ids, weight, x in _rows(batches):
                gap = np.maximum(0, 1 - (x @ _matrix(row.column("drawn")[0]).T).max(axis=1)) * np.maximum(0.001, weight)
                whole = row.column("far")[0].as_py()
                taken = np.flatnonzero(_uniform(ids, salt) * whole < OVER * most * gap)
                yield pa.RecordBatch.from_arrays([pa.repeat(row.column(KEY)[0], len(taken)), pa.array(ids[taken]), pa.array(x[taken].tolist(), pa.list_(pa.float64()))], [KEY, "id", "u"])

        return run

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, weight, x in _rows(batches):
            drawn = _matrix(row.column("drawn")[0])
            mass = np.bincount((x @ drawn.T).argmax(axis=1), np.maximum(0.001, weight), len(drawn))
            yield pa.RecordBatch.from_arrays([pa.repeat(row.column(KEY)[0], len(mass)), pa.array(range(len(mass))), pa.array(mass)], [KEY, "at", "mass"])

    spark = held.sparkSession
    begun = held.mapInArrow(first, f"{KEY} {kind}, weight double, id long, u array<double>").groupBy(KEY).agg(F.max_by("u", F.struct("weight", "id")).alias("u"))
    drawn = publish(begun.select(KEY, F.array("u").alias("drawn")), scratch(spark, "kmeans"))
    for salt in range(ROUNDS):
        facing = held.join(drawn, KEY)
        gaps = facing.mapInArrow(far, f"{KEY} {kind}, far double").groupBy(KEY).agg(F.sum("far").alias("far")).filter(f"far > {STILL}")
        new = facing.join(gaps, KEY).mapInArrow(more(salt), f"{KEY} {kind}, id long, u array<double>").groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("id", "u"))).alias("new"))
        drawn = publish(drawn.join(new, KEY, "left").select(KEY, F.concat("drawn", F.coalesce(F.transform("new", lambda x: x["u"]), F.array().cast(VECTORS))).alias("drawn")), scratch(spark, "kmeans"))
    mass = held.join(drawn, KEY).mapInArrow(masses, f"{KEY} {kind}, at long, mass double").groupBy(KEY, "at").agg(F.sum("mass").alias("mass"))
    mass = mass.groupBy(KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "mass"))), lambda x: x["mass"]).alias("mass"))
    return drawn.join(mass, KEY)


def passed(held: DataFrame, centres: DataFrame) -> DataFrame:
    """Sums of every cluster, by block: recording_id and SUMS. label -1 is the block's worst placed vector, cos how well it is.
    centres: recording_id, problems (array of k and its k centres)."""
    kind = dict(held.dtypes)[KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, weight, x in _rows(batches):
            floor, out = np.maximum(0.001, weight), []
            for problem in row.column("problems")[0].as_py():
                centre = np.array(problem["c"], float)
                near = x @ centre.T
                labels, cos = near.argmax(axis=1), near.max(axis=1)
                member = np.equal.outer(np.arange(len(centre)), labels).astype(float)
                total, n = member @ (x * floor[:, None]), member.sum(axis=1)
                cost, close, mass = ((member * v).sum(axis=1) for v in ((1 - cos) * weight, cos * floor, floor))
                for c in np.flatnonzero(n):
                    out.append((problem["k"], c, total[c], int(n[c]), cost[c], close[c], mass[c], int(ids[labels == c].min())))
                worst = int(np.lexsort((ids, cos))[0])
                out.append((problem["k"], -1, x[worst], 0, 0.0, cos[worst], 0.0, int(ids[worst])))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.repeat(row.column(KEY)[0], len(out)), *[pa.array([v.tolist() for v in c] if t == "array<double>" else c, pa.list_(pa.float64()) if t == "array<double>" else {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[t]) for c, t in zip(columns, (s.split()[1] for s in SUMS.split(", ")), strict=True)]], [KEY, *(s.split()[0] for s in SUMS.split(", "))])

    return held.join(centres, KEY).mapInArrow(run, f"{KEY} {kind}, {SUMS}")


def settled(held: DataFrame, beginnings: DataFrame, iterations: int) -> DataFrame:
    """recording_id, k, c: the centres when none moves. beginnings: recording_id, k, c."""
    spark, kind = held.sparkSession, dict(held.dtypes)[KEY]
    schema = f"{KEY} {kind}, k int, c {VECTORS}, moves double"

    def moved(key: tuple, group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        """The means of all clusters of one recording and k, from its blocks' sums."""
        if not len(before):
            return pd.DataFrame([], columns=[KEY, "k", "c", "moves"])
        old = np.array([list(v) for v in before["c"].iloc[0]], float)
        new = old.copy()
        whole = group[group["label"] >= 0]
        for label, rows in whole.groupby("label"):
            total = np.stack(rows["total"].to_numpy()).sum(axis=0)
            length = np.linalg.norm(total)
            new[label] = total / length if length > 1e-12 else old[label]
        worst = group[group["label"] < 0].sort_values(["cos", "first"])
        for label in sorted(set(range(len(old))) - set(whole["label"])):
            new[label] = worst["total"].iloc[0]
        return pd.DataFrame([(before[KEY].iloc[0], int(before["k"].iloc[0]), new.tolist(), float(np.abs(new - old).max()))], columns=[KEY, "k", "c", "moves"])

    found, done = publish(beginnings.select(KEY, "k", "c", F.lit(1.0).alias("moves")), scratch(spark, "kmeans")), []
    for _ in range(iterations):
        problems = found.groupBy(KEY).agg(F.collect_list(F.struct("k", "c")).alias("problems"))
        sums = passed(held, problems)
        found = publish(sums.groupBy(KEY, "k").cogroup(found.groupBy(KEY, "k")).applyInPandas(moved, schema), scratch(spark, "kmeans"))
        done.append(found.filter(f"moves <= {STILL}"))
        found = found.filter(f"moves > {STILL}")
        if found.isEmpty():
            break
    for part in done:
        found = found.unionByName(part)
    return found.select(KEY, "k", "c")


def speakers(vectors: DataFrame, p: Clusters = Clusters()) -> DataFrame:
    """What clusters.speakers gives, for recordings of any size: recording_id, vec_id, label, k_nme, k."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[KEY]
    held = blocks(vectors)
    known = publish(clusters.estimates(vectors, p).select(F.col(KEY).cast(kind).alias(KEY), "k_nme"), scratch(spark, "kmeans"))
    n = held.groupBy(KEY).agg(F.sum(F.size("ids")).alias("n"))
    least = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.greatest(F.lit(1), F.least(F.lit(p.max_k), F.col("n").cast("int"), F.col("k_nme") + d))))
    wanted = known.join(n, KEY).select(KEY, "k_nme", F.explode(least).alias("k"))

    def begin(group: pd.DataFrame) -> pd.DataFrame:
        x, mass, k = np.array([list(v) for v in group["drawn"].iloc[0]], float), np.array(group["mass"].iloc[0], float), int(group["k"].iloc[0])
        labels = clusters.spherical_kmeans(x, mass, k)
        centre = [(x * mass[:, None])[labels == c].sum(axis=0) for c in range(k) if (labels == c).any()]
        centre += [x[c % len(x)] for c in range(len(centre), k)]
        return pd.DataFrame([(group[KEY].iloc[0], k, [(c / max(np.linalg.norm(c), 1e-12)).tolist() for c in centre])], columns=[KEY, "k", "c"])

    begun = wanted.join(candidates(held, p.max_k), KEY).groupBy(KEY, "k").applyInPandas(begin, f"{KEY} {kind}, k int, c {VECTORS}")
    centres = publish(settled(held, begun, p.iterations), scratch(spark, "kmeans"))

    def judged(key: tuple, group: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        group = group[group["label"] >= 0]
        if not len(group) or not len(of):
            return pd.DataFrame([], columns=[KEY, "k", "quality", "order"])
        sums = group.groupby("label").agg(cost=("cost", "sum"), cos=("cos", "sum"), weight=("weight", "sum"), first=("first", "min"))
        c, k = np.array([list(v) for v in of["c"].iloc[0]], float)[sums.index], int(of["k"].iloc[0])
        apart = 1 - c @ c.T + 9 * np.eye(len(c))
        near = float(apart.min()) if len(c) > 1 else 0.0
        whole = float(of["whole"].iloc[0])
        quality = p.concentration_weight * round(float((sums["cos"] / sums["weight"]).mean()), 6) + p.nearest_weight * round(near, 6) - p.intra_weight * round(sums["cost"].sum() / max(1e-9, whole), 6) - p.deviation_weight * abs(k - int(of["k_nme"].iloc[0]))
        order = np.full(len(of["c"].iloc[0]), -1)
        order[sums.index[np.argsort(sums["first"])]] = np.arange(len(sums))
        return pd.DataFrame([(of[KEY].iloc[0], k, round(quality, 6), order.tolist())], columns=[KEY, "k", "quality", "order"])

    weights = held.groupBy(KEY).agg(F.sum(F.aggregate("weight", F.lit(0.0), lambda a, x: a + x)).alias("whole"))
    facts = centres.join(known, KEY).join(weights, KEY)
    sums = passed(held, centres.groupBy(KEY).agg(F.collect_list(F.struct("k", "c")).alias("problems")))
    judgements = sums.groupBy(KEY, "k").cogroup(facts.groupBy(KEY, "k")).applyInPandas(judged, f"{KEY} {kind}, k int, quality double, order array<int>")
    rank = F.struct("quality", -F.abs(F.col("k") - F.col("k_nme")), -F.col("k"))
    best = judgements.join(known, KEY).groupBy(KEY, "k_nme").agg(F.max_by(F.struct("k", "order"), rank).alias("b")).select(KEY, "k_nme", "b.k", "b.order")
    chosen = publish(best.join(centres, [KEY, "k"]), scratch(spark, "kmeans"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, _, x in _rows(batches):
            at = np.array(row.column("order")[0].as_py())[(x @ _matrix(row.column("c")[0]).T).argmax(axis=1)]
            size = len(ids)
            yield pa.RecordBatch.from_arrays([pa.repeat(row.column(KEY)[0], size), pa.array(ids), pa.array(at, pa.int32()), pa.repeat(row.column("k_nme")[0], size), pa.repeat(row.column("k")[0], size)], [KEY, "vec_id", "label", "k_nme", "k"])

    return held.join(chosen, KEY).mapInArrow(label, f"{KEY} {kind}, vec_id long, label int, k_nme int, k int")
