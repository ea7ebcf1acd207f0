"""Steps whose rows must follow the input: what broke or grew beyond it on large tables."""

import json

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from voxframe.operators import clusters
from voxframe.plans import catalogue
from voxframe.sources import task_store
from voxframe.streaming import sessions


def test_collar_makes_no_frames_of_the_whole_recording(spark, monkeypatch):
    """One recording lasts 10**13 ms: 10**11 frames, of which its boundaries' collars hold a few."""
    last = 10**13
    rows = [(1, 1000, 2000), (1, 2000, last), (2, 0, 130)]
    df = spark.createDataFrame(rows, "recording_id long, start_ms long, end_ms long")
    monkeypatch.setattr(catalogue.v, "segments", lambda spark, sf: df)
    got = sorted(tuple(r) for r in catalogue.eval_collar(spark, "").collect())
    of = lambda end, *edges: [c for e in edges for c in range((e - 250) // 100 * 100 - 50, e + 400, 100) if abs(c - e) <= 250 and 50 <= c < end + 50]
    assert got == sorted({*((1, c) for c in of(last, 1000, 2000, last)), *((2, c) for c in of(130, 0, 130))})


def _vectors(spark, recordings: int, n: int):
    rows = [(r, r * n + i, [float((i * 7 + r + d * d) % 11 - 5) + 0.01 * i for d in range(4)], 1.0) for r in range(recordings) for i in range(n)]
    return spark.createDataFrame(rows, "recording_id long, vec_id long, embedding array<double>, weight double")


def test_many_small_recordings_are_clustered_by_several_tasks(spark):
    """Their vectors are few bytes and their clustering is long; partitions put together by bytes made it one task."""
    for found in (clusters.speakers, clusters.k_candidates, clusters.estimates):
        assert found(_vectors(spark, 24, 3)).select(F.spark_partition_id().alias("task")).distinct().count() > 2


def test_a_long_recording_has_few_copies_of_its_vectors(spark, monkeypatch):
    """Blocks grow before they become more: 16 of them have 136 pairs, where 50 small ones had 1275."""
    monkeypatch.setattr(clusters, "BLOCK", 4)
    rows = clusters.facing_blocks(_vectors(spark, 1, 200)).select(F.size("a").alias("a"), F.size("b").alias("b"), "block", "other").collect()
    assert len(rows) == len({(r.block, r.other) for r in rows}) == 136
    assert sum(r.a * r.b if r.block < r.other else r.a * (r.a - 1) // 2 for r in rows) == 200 * 199 // 2


@pytest.mark.parametrize("blocks", [1, 2])
def test_blocks_of_several_strips_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(clusters, "BLOCKS", blocks)
    x = np.random.default_rng(blocks).normal(size=(701, 6))
    df = spark.createDataFrame([(3, i, v.tolist(), 1.0) for i, v in enumerate(x)], "recording_id long, vec_id long, embedding array<double>, weight double")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    got = clusters.median_cosine(df, 12).first()
    assert (got.n_pairs, got.median_cosine) == (701 * 350, pytest.approx(np.median(cos[np.triu_indices(701, 1)]), abs=1e-11))
    np.fill_diagonal(cos, -2)
    near = {(r.i, r["rank"]): r.j for r in clusters.neighbours(df, 3).collect()}
    assert near == {(i, k + 1): j for i, row in enumerate(cos) for k, j in enumerate(np.argsort(-row)[:3])}


def test_states_of_a_stream_make_no_frame_per_task(spark, tmp_path):
    """A pandas frame for every task took most of the time; over two micro-batches the answer is still that of the table."""
    rows = [(f"t{i % 5}", ("created", "started", "cancel_requested", "succeeded", "failed", "expired")[i % 6], 1000 * i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "task_id string, event string, at_ms long, seq long")
    for k in (0, 1):
        df.filter(F.floor(F.col("seq") / 20) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    states = sessions.task_states(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    assert "InPandas" not in states._jdf.queryExecution().logical().toString()
    got = sessions.drained(states, spark, "update", "states", ("task_id",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sessions.task_states_batch(df).select(*got.columns).collect()))


def test_a_sink_writes_only_the_newest_of_a_tasks_rows(tmp_path):
    """Each row was a file of its own, replaced by the next; deletions still count, and what is older than they are stays away."""
    a, b = "a" * 32, "b" * 32
    rows = [Row(task_id=a, status="running", updated_at_ms=k) for k in range(1, 50)]
    rows += [Row(task_id=b, status="running", updated_at_ms=2), Row(task_id=b, status="deleted", updated_at_ms=3), Row(task_id=b, status="running", updated_at_ms=1)]
    done = task_store.TaskWriter({"path": f"file://{tmp_path}"}).write(iter(rows))
    assert (done.written, done.kept) == (1, 51)
    assert [p.name for p in tmp_path.iterdir()] == [a]
    assert json.loads((tmp_path / a / "task.json").read_text())["updated_at_ms"] == 49
