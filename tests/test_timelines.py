"""Block scans, parallel batches and scaled joins against window functions, plain loops and brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from voxframe.operators import intervals, packing, timeline, windows
from voxframe.operators.timelines import WINDOWS, Blocks
from voxframe.params import Packing

SEGMENT = "recording_id long, input_index long, start_ms long, end_ms long, text string, confidence double"


def segments(spark, n=300, keys=3, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        a = r.randrange(0, 60_000)
        rows.append((r.choice([1] * 6 + list(range(keys))), k, a, a + r.randrange(0, 400), "x" * r.randrange(5), r.random()))
    return spark.createDataFrame(rows, SEGMENT)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("how", ["max", "min", "sum", "last"])
@pytest.mark.parametrize("before", [True, False])
def test_running_values(spark, how, before):
    r = random.Random(7)
    data = [(r.choice([None, 1, 1, 1, 2]), k, r.choice([None, r.randrange(100)])) for k in range(120)]
    df = spark.createDataFrame(data, "recording_id long, start_ms long, x long")
    out = {}
    for by in (WINDOWS, Blocks(7)):
        dealt = by.deal(df, ("start_ms",), ("recording_id",))
        out[by] = rows_of(by.running(dealt, "y", F.col("x"), how, ("start_ms",), ("recording_id",), before).select("recording_id", "start_ms", "x", "y"))
    a, b = out.values()
    assert a == b and len(a) == 120


@pytest.mark.parametrize("blocks", [1, 5, 40])
def test_operators_by_blocks(spark, blocks):
    df, by = segments(spark), Blocks(blocks)
    assert rows_of(intervals.union(df)) == rows_of(intervals.union(df, by=by))
    assert rows_of(windows.candidates(df)) == rows_of(windows.candidates(df, by=by))
    empty = df.filter("start_ms < 0")
    assert intervals.union(empty, by=by).collect() == windows.candidates(empty, by=by).collect() == []


def test_speaker_runs_by_blocks(spark):
    r = random.Random(3)
    rows = [(k % 2, 300 * k, 300 * k + r.choice([200, 300]), r.choice([0, 1, 1, 1, 1, 1, 2]), r.choice(["", "a", "a", "a", "b"])) for k in range(240)]
    df = spark.createDataFrame(rows, "recording_id long, start_ms long, end_ms long, active int, dom string")
    want = rows_of(timeline.single_speaker_runs(df))
    assert rows_of(timeline.single_speaker_runs(df, by=Blocks(9))) == want and len(want) > 10


def test_one_long_recording_spreads_over_all_blocks(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("recording_id"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + F.col("id") % 97 % 12).alias("end_ms"))
    dealt = Blocks(16).deal(df, ("start_ms", "end_ms"), ("recording_id",))
    sizes = [r["count"] for r in dealt.groupBy("_block").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * n / 16
    a, b = (intervals.union(df, by=by).agg(F.count("*"), F.sum("start_ms"), F.sum("end_ms")).first() for by in (WINDOWS, Blocks(16)))
    assert a == b


def greedy(rows, p):
    out, of = [], None
    for key, place, d, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if key != of:
            of, batch, n, ms, size = key, -1, p.windows, 0, 0
        if n >= p.windows or ms + d > p.seconds * 1000 or size + b > p.bytes:
            batch, n, ms, size = batch + 1, 0, 0, 0
        n, ms, size = n + 1, ms + d, size + b
        out.append((key, place, batch))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [1, 3, 17, 90])
def test_batches_in_blocks(spark, blocks):
    r = random.Random(blocks)
    rows = [(r.choice([1, 1, 1, 1, 2, 3]), k, r.choice([0, 100, 900, 4000, 70_000]), r.choice([0, 10, 2000])) for k in range(260)]
    df = spark.createDataFrame(rows, "recording_id long, place long, duration_ms long, n_bytes long")
    for p in (Packing(), Packing(windows=3, seconds=5.0, bytes=2500), Packing(windows=1), Packing(windows=400, seconds=40.0)):
        got = sorted(map(tuple, packing.batches_in_blocks(df, p, blocks).collect()), key=str)
        assert got == greedy(rows, p) == sorted(map(tuple, packing.batches(df, p).collect()), key=str)
    assert packing.batches_in_blocks(df.filter("place < 0"), blocks=blocks).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_walks(seed):
    rng = np.random.default_rng(seed)
    ms, size = rng.integers(0, 9000, 200), rng.integers(0, 9000, 200)
    p = Packing(windows=int(rng.integers(1, 20)), seconds=20.0, bytes=20_000)
    after = packing._next_heads(ms, size, p)
    count, last = packing._walks(after)
    for i in range(200):
        heads = [i]
        while (j := after[heads[-1]]) < 200:
            heads.append(j)
        assert (count[i], last[i]) == (len(heads), heads[-1])
        j = after[i]
        assert i < j <= i + p.windows and (j == i + 1 or (ms[i:j].sum() <= 20_000 and size[i:j].sum() <= 20_000))
        assert j == 200 or j - i == p.windows or ms[i : j + 1].sum() > 20_000 or size[i : j + 1].sum() > 20_000


def mixed(rng, n, far):
    """Intervals from nothing to days long, before and after 0."""
    start = rng.integers(-far, far, n)
    length = np.where(rng.random(n) < 0.5, rng.integers(0, 50, n), (10 ** rng.uniform(1, 8, n)).astype(np.int64))
    return pd.DataFrame({"recording_id": rng.integers(0, 3, n), "start_ms": start, "end_ms": start + length})


@pytest.mark.parametrize("leaf", [1, 1000, 60_000])
def test_scaled_join(spark, leaf):
    rng = np.random.default_rng(leaf)
    a, b = mixed(rng, 120, 30_000_000), mixed(rng, 140, 30_000_000)
    a["a"], b["b"] = range(120), range(140)
    left, right = spark.createDataFrame(a), spark.createDataFrame(b)
    want = {(x.a, y.b) for x in a.itertuples() for y in b.itertuples() if x.recording_id == y.recording_id and y.start_ms < x.end_ms and y.end_ms > x.start_ms}
    if leaf > 1:
        got = [(r.a, r.b) for r in intervals.scaled_join(left, right, leaf).collect()]
        assert set(got) == want and len(got) == len(want)
        assert {r.a for r in intervals.scaled_join(left, right, leaf, "left_semi").collect()} == {x for x, _ in want}
        assert {r.a for r in intervals.scaled_join(left, right, leaf, "left_anti").collect()} == set(range(120)) - {x for x, _ in want}
    short = spark.createDataFrame(a[a.end_ms - a.start_ms < 50]), spark.createDataFrame(b[b.end_ms - b.start_ms < 50])
    got = {(r.a, r.b) for r in intervals.scaled_join(*short, leaf).collect()}
    assert got == {(x, y) for x, y in want if (a.end_ms - a.start_ms)[x] < 50 and (b.end_ms - b.start_ms)[y] < 50}
    assert intervals.scaled_join(left.filter("a < 0"), right, leaf).collect() == []


def test_days_against_short_frames_deal_few_rows(spark):
    day = 86_400_000
    days = spark.range(3).select(F.lit(1).cast("long").alias("recording_id"), (F.col("id") * day + 17).alias("start_ms"), ((F.col("id") + 1) * day - 5).alias("end_ms"), "id")
    frames = spark.range(20_000).select(F.lit(1).cast("long").alias("recording_id"), (F.col("id") * 12_960).alias("start_ms"), (F.col("id") * 12_960 + 10).alias("end_ms"))
    long, short = ([r[0] for r in intervals.scaled(x, 60_000).select("_level").distinct().collect()] for x in (days, frames))
    assert (long, short) == ([intervals.TOP], [0])
    dealt = intervals.scaled(days, 60_000, short).count(), intervals.scaled(frames, 60_000, long).count()
    assert dealt[0] <= 3 * (day // (60_000 << intervals.TOP) + 2) and dealt[1] <= 2 * 20_010  # not 1440 buckets a day
    assert intervals.scaled_join(frames, days, 60_000).count() == intervals.overlap_join(frames, days, 60_000).count() > 19_000
