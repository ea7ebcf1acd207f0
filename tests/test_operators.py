"""Operators on small fixtures and against plain loops."""

import itertools
import json
import random
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from voxframe import params
from voxframe.functions import text as tx
from voxframe.functions import vectors as vx
from voxframe.operators import assign, clusters, evaluate, intervals, models, packing, timeline, windows
from voxframe.plans import catalogue, views
from voxframe.sources import audio, documents, exports, task_store
from voxframe.streaming import sessions

SEG = "recording_id long, input_index long, start_ms long, end_ms long, text string, confidence double"


def seg(spark, rows):
    return spark.createDataFrame([(1, i, s, e, t, c) for i, (s, e, t, c) in enumerate(rows)], SEG)


def test_candidates_merge_up_to_the_gap(spark):
    rows = [(0, 1000, "a", 0.5), (1500, 2200, "b", None), (2701, 3000, "", 0.9), (2750, 2800, "c", None)]
    got = windows.candidates(seg(spark, rows)).orderBy("start_ms").collect()
    assert [(r.candidate_id, r.start_ms, r.end_ms, r.source_segment_indices, r.max_internal_gap_ms, r.avg_confidence) for r in got] == [("asr_candidate_000", 0, 2200, [0, 1], 500, 0.5), ("asr_candidate_001", 2701, 3000, [2, 3], 0, 0.9)]


def test_sessions_equal_candidates(spark):
    random.seed(1)
    rows = [(s := random.randrange(40_000), s + random.randrange(1, 900), "x", None) for _ in range(200)]
    a = {(r.start_ms, r.end_ms, r.segment_count) for r in windows.candidates(seg(spark, rows)).collect()}
    assert a == {(r.start_ms, r.end_ms, r.segment_count) for r in sessions.session_candidates(seg(spark, rows)).collect()}


WIN = "window_id string, start_ms long, end_ms long, duration_ms long, speech_ratio double, overlap_ms long, change_point_count int, loudness_db double, loudness_std_db double, boundary_left_silence_ms long, boundary_right_silence_ms long, flags array<string>"


@pytest.mark.parametrize(
    ("row", "score", "tier", "rejects"),
    [
        ((3000, 0.9, 0, 0, -20.0, 4.0, 100, 100, []), 100.0, "clean", []),
        ((1000, 0.5, 0, 0, -60.0, 4.0, 100, 100, []), 100.0, "rejected", ["duration_too_short", "speech_ratio_too_low", "loudness_too_low"]),
        ((2000, 0.75, 0, 0, -20.0, 12.0, 79, 80, []), 76.0, "usable", []),
        ((1999, 0.70, 0, 0, -20.0, 12.1, 0, 0, ["low_speech_ratio"]), 25.0, "rejected", []),
        ((5000, 0.85, 0, 0, None, 8.0, 80, 80, []), 100.0, "rejected", ["loudness_too_low"]),
        ((5000, None, 1, 2, -20.0, None, None, 80, None), 97.0, "rejected", ["speech_ratio_too_low", "overlap_detected", "speaker_change_detected"]),
    ],
)
def test_scores(spark, row, score, tier, rejects):
    df = spark.createDataFrame([("w", 0, row[0], *row)], WIN)
    r = windows.scored(df).first()
    assert (r.score, r.tier, r.reject_reasons) == (score, tier, rejects)


def test_overlap_join_equals_a_plain_loop(spark):
    random.seed(2)
    make = lambda: [(random.randrange(2), i, s := random.randrange(5000), s + random.randrange(1, 1200)) for i in range(60)]
    a, b = make(), make()
    da, dbb = spark.createDataFrame(a, "recording_id long, a long, start_ms long, end_ms long"), spark.createDataFrame(b, "recording_id long, b long, start_ms long, end_ms long")
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}
    rows = intervals.overlap_join(da, dbb, bucket_ms=500).select("a", "b").collect()
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)
    for how in ("left_semi", "left_anti"):
        hit = {x for x, _ in want}
        got = {r.a for r in intervals.overlap_join(da, dbb, 500, how).collect()}
        assert got == {x[1] for x in a if (x[1] in hit) == (how == "left_semi")}


def runs_by_loop(frames, gap=500, trim=200):
    """Blocked ranges and runs, frame by frame."""
    ranges, last, quiet = [], None, 0
    for s, e, n, who in frames:
        if n == 0:
            quiet += e - s
        elif n >= 2:
            ranges.append((s - trim, e + trim))
            last = None
        else:
            if last and last[1] and who and last[1] != who and quiet <= gap:
                ranges.append((max(last[0], s) - trim, max(last[0], s) + trim))
            last = (e, who)
        quiet = 0 if n else quiet
    merged = []
    for s, e in sorted(ranges):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    groups, now = [], None
    for s, e, n, _ in frames:
        if n >= 2 or any(a < e and b > s for a, b in merged):
            groups += [now] if now else []
            now = None
        elif n == 0:
            if now and e - now[1] > gap:
                groups.append(now)
                now = None
        elif now and s - now[1] <= gap:
            now = (now[0], e)
        else:
            groups += [now] if now else []
            now = (s, e)
    return [tuple(m) for m in merged], groups + ([now] if now else [])


@pytest.mark.parametrize("seed", range(4))
def test_runs_by_loop(spark, seed):
    rng = random.Random(seed)
    frames, at = [], 0
    for _ in range(250):
        length = rng.choice([50, 100, 300])
        n = rng.choices([0, 1, 2], [3, 8, 1])[0]
        frames.append((at, at + length, n, "" if n == 0 else rng.choices(["a", "b", ""], [8, 2, 1])[0]))
        at += length
    df = spark.createDataFrame([(1, *f) for f in frames], "recording_id long, start_ms long, end_ms long, active int, dom string")
    blocked, runs = runs_by_loop(frames)
    assert sorted((r.start_ms, r.end_ms) for r in timeline.blocked(df).collect()) == blocked
    assert sorted((r.start_ms, r.end_ms) for r in timeline.single_speaker_runs(df).collect()) == runs


def axis(i, off):
    v = np.zeros(32)
    v[i], v[i + 1] = 1, off
    return (v / np.linalg.norm(v)).tolist()


def test_clusters_of_separable_speakers(spark):
    rows = [(1, i * 8 + j, axis(10 * i, 0.005 * j), 1.0) for i in range(3) for j in range(8)] + [(2, j, axis(0, 0.01 * j), 1.0) for j in range(5)]
    df = spark.createDataFrame(rows, "recording_id long, vec_id long, embedding array<double>, weight double")
    got = clusters.speakers(df).toPandas()
    one = got[got.recording_id == 1].sort_values("vec_id")
    assert one["k"].tolist() == [3] * 24 and one["label"].tolist() == [0] * 8 + [1] * 8 + [2] * 8
    assert set(got[got.recording_id == 2]["k"]) == {1}
    again = clusters.speakers(df.repartition(7)).toPandas()
    assert got.sort_values(["recording_id", "vec_id"]).values.tolist() == again.sort_values(["recording_id", "vec_id"]).values.tolist()


def strongest(x, w, k):
    """i, j, rank, affinity of each row's k strongest neighbours, from the whole matrix."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    value = np.maximum(x @ x.T, 0) ** 2 * np.sqrt(np.outer(w, w))
    np.fill_diagonal(value, -1)
    return pd.DataFrame([(i, j, r + 1, value[i, j]) for i in range(len(x)) for r, j in enumerate(np.argsort(-value[i].round(9), kind="stable")[:k])], columns=["i", "j", "rank", "affinity"])


def test_lanczos_agrees_with_the_dense_spectrum():
    """Also where the least value is there several times, as in a graph of separate parts, and when it begins anew."""
    rng = np.random.default_rng(0)
    for noise in (0.1, 0.0, 1.0):
        x = np.concatenate([np.eye(32)[10 * i] + noise * rng.normal(size=(140, 32)) + 1e-3 * rng.normal(size=(140, 32)) * (np.arange(32) // 10 == i) for i in range(3)])
        e = strongest(x, np.ones(len(x)), 5)
        edges = [e[c].to_numpy() for c in ("i", "j", "affinity")]
        dense = clusters.spectrum(*edges, len(x), 6)
        for basis in (40, 90, 10_000):
            sparse = clusters.spectrum(*edges, len(x), 6, params.Clusters(dense_limit=10, lanczos_basis=basis))
            assert np.allclose(dense[:7], sparse, atol=1e-6)
        assert (dense[:3] < 1e-9).all() or noise


def test_estimates_by_the_whole_matrix(spark, monkeypatch):
    """Blocks of vectors, ties and unusable vectors give what a dense solver gives for the whole recording."""
    monkeypatch.setattr(clusters, "BLOCK", 16)
    rng = np.random.default_rng(11)
    rows = [(r, 1000 * r + 7 * i, (np.eye(12)[i % r * 3] + 0.25 * rng.normal(size=12)).tolist(), float(rng.uniform(0.2, 1))) for r, n in ((1, 1), (2, 2), (3, 60), (4, 41)) for i in range(n)]
    rows += [(4, 9000 + i, rows[80][2], 1.0) for i in range(5)] + [(4, 9100, [0.0] * 12, 1.0), (5, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "recording_id long, vec_id long, embedding array<double>, weight double")
    got = {r.recording_id: r for r in clusters.estimates(df).collect()}
    assert set(got) == {1, 2, 3, 4} and (got[1].k_nme, got[1].method, got[1].median_cosine) == (1, "singleton", None)
    for r in (2, 3, 4):
        mine = sorted((i, e, w) for rec, i, e, w in rows if rec == r and any(e))
        x, w = np.array([e for _, e, _ in mine]), np.array([w for *_, w in mine])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        median = float(np.median((unit @ unit.T)[np.triu_indices(len(x), 1)]))
        k, found = clusters.estimate_k(strongest(x, w, 8), len(x), median)
        assert (got[r].k_nme, got[r].method) == (k, found["method"]) and got[r].median_cosine == pytest.approx(median, abs=1e-12)
        assert np.allclose(got[r].eigenvalues, found["eigenvalues"], atol=2e-6)
        assert np.allclose([g.score for g in got[r].gaps], [g[0] for g in found["gaps"]], atol=2e-6)
    assert clusters.estimates(df.limit(0)).collect() == []


def test_blocks_of_vectors_against_all_pairs(spark, monkeypatch):
    """Copies tie, a recording of one vector has no pair, null and zero vectors and those without weight have no part."""
    monkeypatch.setattr(clusters, "BLOCK", 7)
    rng = np.random.default_rng(6)
    rows = [(r, 100 * r + i, rng.normal(size=5).tolist(), float(rng.uniform(0.2, 1))) for r, n in ((1, 1), (2, 2), (3, 9), (4, 40)) for i in range(n)]
    rows += [(4, 500 + i, rows[20][2], rows[20][3]) for i in range(12)]
    unusable = [(4, 600, None, 1.0), (4, 601, [0.0] * 5, 1.0), (4, 602, [1.0] * 5, 0.0)]
    df = spark.createDataFrame(rows + unusable, "recording_id long, vec_id long, embedding array<double>, weight double")
    near, median = {}, {}
    for r in (2, 3, 4):
        ids, x, w = zip(*[(i, np.array(e) / np.linalg.norm(e), w) for rec, i, e, w in rows if rec == r], strict=True)
        cos = np.stack(x) @ np.stack(x).T
        median[r] = (len(x) * (len(x) - 1) // 2, round(float(np.median(cos[np.triu_indices(len(x), 1)])), 6))
        value = np.maximum(cos, 0) ** 2 * np.sqrt(np.outer(w, w))
        for a, i in enumerate(ids):
            best = sorted((-round(float(value[a, b]), 9), j) for b, j in enumerate(ids) if b != a)[:8]
            near |= {(r, i, rank): (j, round(-v, 6)) for rank, (v, j) in enumerate(best, 1)}
    got = {(r.recording_id, r.i, r["rank"]): (r.j, round(r.affinity, 6)) for r in clusters.neighbours(df).collect()}
    assert got.keys() == near.keys() and all(got[k] == pytest.approx(near[k]) for k in near)
    got = {r.recording_id: (r.n_pairs, r.median_cosine) for r in clusters.median_cosine(df).collect()}
    assert got.keys() == median.keys() and all(got[r] == pytest.approx(median[r]) for r in median)
    assert clusters.neighbours(df.limit(0)).count() == clusters.median_cosine(df.limit(0)).count() == 0


def test_kmeans_takes_the_best_of_its_starts():
    rng = np.random.default_rng(8)
    x = np.concatenate([np.eye(8)[i] + 0.05 * rng.normal(size=(12, 8)) for i in (0, 3, 5)])
    labels = clusters.spherical_kmeans(x, np.ones(len(x)), 3)
    assert labels.tolist() == [0] * 12 + [1] * 12 + [2] * 12
    assert clusters.spherical_kmeans(x, np.ones(len(x)), 1).tolist() == [0] * 36
    assert len(set(clusters.spherical_kmeans(x[:2], np.ones(2), 5).tolist())) == 2


def test_centres_by_plain_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(1 + i % 2, i, i % 3, rng.normal(size=5).tolist(), float(rng.uniform(0.1, 1))) for i in range(60)]
    df = spark.createDataFrame(rows, "recording_id long, vec_id long, label int, embedding array<double>, weight double").repartition(5)
    for r in clusters.centres(clusters.usable(df)).collect():
        mine = [np.array(x[3]) / np.linalg.norm(x[3]) * x[4] for x in rows if (x[0], x[2]) == (r.recording_id, r.label)]
        assert np.allclose(r.centre, sum(mine) / np.linalg.norm(sum(mine)))


def test_lower_quantile(spark):
    df = spark.createDataFrame([(1, 0, i, v, w) for i, (v, w) in enumerate([(0.1, 1.0), (0.2, 1.0), (0.3, 2.0), (0.4, 0.5)])], "recording_id long, label int, vec_id long, d double, weight double")
    assert clusters.lower_quantiles(df, "d", (0.2, 0.5, 0.9, 1.0)).first()[2:] == (0.1, 0.3, 0.4, 0.4)


def test_radii_are_ordered(spark):
    a = clusters.anchors(views.gold(spark, "/root/testdata/sf0.001")).collect()
    assert a and all(r.core_radius <= r.boundary_radius == r.accept_radius for r in a)


def test_an_anchor_takes_its_segment(spark):
    gold = spark.createDataFrame([(1, i, 0, axis(0, 0.01 * i), 1.0) for i in range(4)], "recording_id long, vec_id long, label int, embedding array<double>, weight double")
    s = spark.createDataFrame([(1, 0, axis(0, 0.01), 2000), (1, 1, None, 2000), (1, 2, axis(20, 0.0), 6000)], "recording_id long, vec_id long, embedding array<double>, duration_ms long")
    s = s.withColumn("speech_ratio", F.lit(0.9)).withColumn("loudness_std_db", F.lit(None).cast("double")).withColumn("loudness_db", F.lit(None).cast("double"))
    got = {r.vec_id: r for r in assign.recalled(assign.strict(assign.top_two(s, clusters.anchors(gold)))).collect()}
    assert got[0].level in ("strong", "normal") and got[0].risk_level == "low"
    assert (got[1].level, got[1].reason, got[1].flags, got[1].risk_score, got[1].reject_reason) == ("unknown", "missing_segment_embedding", ["no_embedding"], 1.0, "no_candidate_speaker")
    assert (got[2].level, got[2].reason, got[2].flags, got[2].reject_reason) == ("unknown", "margin_too_low", ["low_relative_margin"], "distance_over_hard_cap")
    none = assign.recalled(assign.strict(assign.top_two(s, clusters.anchors(gold.filter("false"))))).orderBy("vec_id").collect()
    assert [(r.reason, r.flags, r.level) for r in none] == [("no_gold_window_speakers", ["no_anchor_speaker"], "unknown"), ("missing_segment_embedding", ["no_embedding"], "unknown"), ("no_gold_window_speakers", ["no_anchor_speaker"], "unknown")]
    made = {r.vec_id: json.loads(r.a) for r in assign.records(assign.recalled(assign.strict(assign.top_two(s, clusters.anchors(gold))))).select("vec_id", F.to_json("assignment").alias("a")).collect()}
    assert made[1]["evidence"] == {"duration_ms": 2000, "quality": {"speech_ratio": 0.9}} and made[1]["risk"] == {"score": 1.0, "level": "unassigned", "flags": ["no_embedding"]}
    assert made[0]["status"] == "assigned" and made[0]["evidence"]["speaker_is_reliable"] and "quality_band" not in made[0]["evidence"]


def test_perfect_attribution(spark):
    rows = [(1, 0, 0, 2000, "a"), (1, 1, 2500, 5000, "b")]
    ref = spark.createDataFrame(rows, "recording_id long, input_index long, start_ms long, end_ms long, speaker string")
    hyp = ref.withColumn("label", F.when(F.col("speaker") == "a", "local_spk_1").otherwise("local_spk_0"))
    m = evaluate.recording_metrics(ref, hyp, evaluate.mapping(ref, hyp)).first().asDict()
    assert m == {"recording_id": 1, "der": 0.0, "jer": 0.0, "speaker_count_exact": 1.0, "speaker_count_mae": 0.0, "assigned_accuracy": 1.0, "coverage": 1.0, "unknown_rate": 0.0}
    assert all(r.passed for r in evaluate.gates(evaluate.recording_metrics(ref, hyp, evaluate.mapping(ref, hyp))).collect())


def test_der_by_loop(spark):
    rng = random.Random(5)
    ref = [(1, i, s := rng.randrange(20_000), s + rng.randrange(100, 3000), rng.choice("ab")) for i in range(14)]
    hyp = [(1, i, s := rng.randrange(20_000), s + rng.randrange(100, 3000), rng.choice(["a", "b", "c", "unknown"])) for i in range(14)]
    edges = [x for r in ref for x in r[2:4]]
    miss = fa = conf = total = 0
    for at in range(50, max(r[3] for r in ref + hyp), 100):
        if any(abs(at - e) <= 250 for e in edges):
            continue
        r, h = {x[4] for x in ref if x[2] <= at < x[3]}, {x[4] for x in hyp if x[4] != "unknown" and x[2] <= at < x[3]}
        miss, fa, conf, total = miss + max(0, len(r) - len(h)), fa + max(0, len(h) - len(r)), conf + min(len(r), len(h)) - len(r & h), total + len(r)
    kind = "recording_id long, input_index long, start_ms long, end_ms long, "
    got = evaluate.der_terms(spark.createDataFrame(ref, kind + "speaker string"), spark.createDataFrame(hyp, kind + "label string").withColumn("mapped", F.col("label"))).first()
    assert got[1:] == (miss, fa, conf, total, round((miss + fa + conf) / max(1, total), 6))


@pytest.mark.parametrize("seed", range(30))
def test_best_mapping_by_permutations(seed):
    rng = random.Random(seed)
    labels, speakers = [f"h{i}" for i in range(rng.randrange(5))], [f"r{i}" for i in range(rng.randrange(5))]
    counts = {(a, b): rng.randrange(4) for a in labels for b in speakers}
    got = evaluate.best_mapping(counts, labels, speakers)
    n = min(len(labels), len(speakers))
    options = [list(zip(a, b)) for a in itertools.permutations(labels, n) for b in itertools.permutations(speakers, n)] or [[]]
    assert len(got) == n == len(set(got.values()))
    assert sum(counts[p] for p in got.items()) == max(sum(counts[p] for p in o) for o in options)


def test_batches_by_loop(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice([1000, 20_000, 30_000, 70_000]), rng.choice([10, 640_000, 40_000_000])) for i in range(120)] + [(2, i, 10_000, 640_000) for i in range(5)]
    df = spark.createDataFrame(rows, "recording_id long, place long, duration_ms long, n_bytes long")
    small = params.Packing(bytes=2 * 640_000)
    for p in (params.Packing(), small):
        want = {}
        for rec in (1, 2):
            batch, held = -1, []
            for _, place, ms, size in (r for r in rows if r[0] == rec):
                if not held or len(held) >= p.windows or sum(h[0] for h in held) + ms > p.seconds * 1000 or sum(h[1] for h in held) + size > p.bytes:
                    batch, held = batch + 1, []
                held.append((ms, size))
                want[rec, place] = batch
        assert {(r.recording_id, r.place): r.batch for r in packing.batches(df, p).collect()} == want
    assert [want[2, i] for i in range(5)] == [0, 0, 1, 1, 2]


def test_bisection_isolates_the_bad_item():
    def run(items):
        if 3 in items:
            raise ValueError
        return [i * 2 for i in items]

    assert packing.bisected([1, 2, 3, 4], run) == [("success", 2), ("success", 4), ("inference_failed", None), ("success", 8)]


def test_boundaries():
    of = lambda starts, *more: packing.cuts(np.array([a for a, _ in starts], int), np.array([c for _, c in starts], bool), *more)
    assert of([(20_000, True), (40_000, True), (41_000, False)], 60_000, 3) == [0, 20_000, 40_000, 60_000]
    assert of([], 60_000, 2) == [0, 30_000, 60_000]
    assert of([(28_000, True), (32_000, True), (30_000, False)], 60_000, 2) == [0, 28_000, 60_000]  # clean ones first, of equals the earlier
    assert of([(30_000, False)], 60_000, 2) == [0, 30_000, 60_000] and of([(1, True)], 60_000, 1) == [0, 60_000]


def test_a_cut_by_trying_every_start():
    rng = random.Random(11)
    for _ in range(200):
        duration, parts = rng.randrange(1000, 400_000), rng.randrange(2, 5)
        starts = [(rng.randrange(duration), rng.random() < 0.5) for _ in range(rng.randrange(8))]
        at = packing.cuts(np.array([a for a, _ in starts], int), np.array([c for _, c in starts], bool), duration, parts)
        least = min(30_000, duration // max(2, 3 * parts))
        for k in range(1, parts):
            goal, low, high = duration * k // parts, at[k - 1] + least, duration - least * (parts - k)
            reach = [a for a, _ in starts if low <= a <= high]
            clean = [a for a, c in starts if c and low <= a <= high]
            pool = clean or reach
            assert at[k] == (min(pool, key=lambda a: (abs(a - goal), a)) if pool else max(low, min(high, goal)))


def test_inference_isolates_what_fails(spark):
    rows = [(1, i, [float(i)] * (1 + i % 3), 16_000 * (1 + i % 3), 5 if i == 4 else 100) for i in range(40)]
    df = spark.createDataFrame(rows, "recording_id long, request long, samples array<double>, n_samples long, deadline_ms long")

    def model():
        def call(batch):
            if any(x[0] == 7 for x in batch):
                raise RuntimeError
            return [[x.sum()] for x in batch]

        return call

    got = {r.request: (r.status, r.result) for r in packing.inferred(df, model, 5).collect()}
    assert len(got) == 40 and got[4] == ("deadline_exceeded", None) and got[7] == ("inference_failed", None)
    assert all(got[i] == ("success", [float(i * (1 + i % 3))]) for i in range(40) if i not in (4, 7))
    sizes = packing.inferred(df, model, 5).filter("batch is not null").groupBy("batch").count().collect()
    assert max(r["count"] for r in sizes) <= 16

    vectors = {r.request: (r.status, r.embedding) for r in models.embeddings(df, model, 5).collect()}
    assert vectors[0] == ("inference_failed", None) and vectors[1] == ("success", [1.0])


def test_segmentation_by_a_model(spark):
    """Two chunks with cores of 100 ms; the model tells silence, a speaker and a pair from the sample's value."""
    rows = [(1, 0, 200, 0, 100, [0.0, 1.0, 1.0, 4.0]), (1, 0, 200, 100, 200, [0.0, 1.0, 1.0, 4.0]), (2, 0, 200, 0, 200, [9.0])]
    df = spark.createDataFrame(rows, "recording_id long, read_start long, read_end long, core_start long, core_end long, samples array<double>")

    def model():
        def call(x):
            if x[0] == 9:
                raise RuntimeError
            return np.eye(7)[x.astype(int)] * 8

        return call

    got = models.segmentation(df, model).orderBy("recording_id", "start_ms").collect()
    assert [(r.recording_id, r.start_ms, r.end_ms, r.active, r.dom) for r in got] == [(1, 0, 50, 0, ""), (1, 50, 100, 1, "speaker_0"), (1, 100, 150, 1, "speaker_0"), (1, 150, 200, 2, "speaker_0")]
    assert all(0.9 < r.confidence <= 1 for r in got)


TRANSCRIPT = """# Record

**[00:00:01–00:00:01] role · speaker_SPEAKER_00_overlap_overlap**

 hello
  there

**[00:00:05–00:00:20] ASR混合 · speaker_B**

clamped
**[00:00:06–00:00:07] role · Somebody**

**[00:00:11–00:00:12] role · speaker_B**

gone
"""


def test_transcript_repairs(spark):
    df = spark.createDataFrame([(1, TRANSCRIPT, 10_000)], "recording_id long, text string, duration_ms long")
    a, b, c = documents.transcript(df).orderBy("source_index").collect()
    assert (a.start_ms, a.end_ms, a.speaker, a.text, a.flags) == (1000, 2000, "speaker_SPEAKER_00", "hello\nthere", ["zero_duration_expanded_to_1000ms", "overlap_suffix_normalized"])
    assert (b.end_ms, b.flags, b.dropped) == (10_000, ["end_clamped_to_audio", "ambiguous_semantic_role"], None) and b.text == "clamped\n**[00:00:06–00:00:07] role · Somebody**"
    assert c.dropped == "start_out_of_bounds"


def test_document_scan_manifest_and_paths(spark, tmp_path):
    doc = {"schema_version": "voice_analysis_input_v1", "metadata": {}, "segments": [{"id": "a", "start_ms": 5, "end_ms": 9, "text": "x"}, {"id": "b", "start_ms": 1, "end_ms": 2, "text": ""}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    rows = documents.segment_documents(spark, f"file://{tmp_path}/d.json").orderBy("input_index").collect()
    assert [(r.input_index, r.id, r.start_ms) for r in rows] == [(0, "a", 5), (1, "b", 1)]
    (tmp_path / "m.jsonl").write_text('{"id": "1", "reference_path": "r"}\n\n{"id": "2", "reference_path": "s", "scenarios": ["overlap"]}\n')
    assert documents.manifest(spark, f"file://{tmp_path}/m.jsonl").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": "1", "reference_path": "r"}\r\n \t\r\n{"id": "2", "reference_path": ""}\n')
    with pytest.raises(Exception, match="EVALUATION_MANIFEST_INVALID: invalid manifest row 3"):
        documents.manifest(spark, f"file://{tmp_path}/bad.jsonl").collect()
    with pytest.raises(ValueError, match="OUTSIDE"):
        documents.contained(str(tmp_path), "../x")


def test_recogniser_answers(spark):
    body = json.dumps({"flash_result": [{"channel_id": 0, "sentence_list": [{"begin_time": 0, "end_time": 900, "text": "a"}, {"begin_time": 1000, "end_time": 900, "text": "b"}]}, {"channel_id": 1}]})
    flat = documents.flattened_flash(spark.createDataFrame([(1, body)], "recording_id long, body string"))
    rows = documents.normalised_asr(flat.select("recording_id", "pos", "begin_time", F.lit(None).alias("start_time"), F.lit(None).alias("time"), "end_time", "text", F.lit("").alias("id"))).orderBy("id").collect()
    assert [(r.id, r.start_ms, r.end_ms, r.violation) for r in rows] == [("asr-1", 0, 900, None), ("asr-2", 1000, 900, "ASR_RESULT_INVALID")]


def test_audio(spark, tmp_path):
    t = np.arange(16_000)
    x = (8000 * np.sin(2 * np.pi * 220 * t / 16_000)).astype("<i2")
    for name, data, rate, channels in (("a", x, 16_000, 1), ("b", np.stack([x, x], 1), 16_000, 2), ("c", x[:3200], 16_000, 1)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(np.ascontiguousarray(data).tobytes())
    (tmp_path / "d.wav").write_bytes(b"")
    (tmp_path / "e.wav").write_bytes(b"nonsense")
    rows = {r.recording[-5]: r for r in audio.probed(spark, f"file://{tmp_path}/*.wav").collect()}
    assert {k: (r.duration_ms, r.error) for k, r in rows.items()} == {"a": (1000, None), "b": (1000, None), "c": (200, "AUDIO_DURATION_LIMIT"), "d": (None, "AUDIO_EMPTY"), "e": (None, "AUDIO_PROBE_FAILED")}
    assert {r.error for r in audio.probed(spark, f"file://{tmp_path}/a.wav", max_bytes=100).collect()} == {"AUDIO_SIZE_LIMIT"}
    frames = audio.power_frames(spark, f"file://{tmp_path}/[ab].wav").toPandas()
    assert len(frames) == 66 and np.allclose(frames["power"], 8000**2 / 2, rtol=0.1)
    got = timeline.loudness(spark.createDataFrame(frames[["recording", "power"]]), ("recording",)).toPandas()
    assert got["speech_ratio"].tolist() == [1.0, 1.0] and np.allclose(got["loudness_db"], 20 * np.log10(8000 / np.sqrt(2) / 32768), atol=0.1)
    cut = spark.createDataFrame([(x.tobytes(),)], "pcm binary").select(audio.pcm_range(F.col("pcm"), F.lit(100), F.lit(200)).alias("p"), audio.pcm_range(F.col("pcm"), F.lit(990), F.lit(5000)).alias("q")).first()
    assert bytes(cut.p) == x[1600:3200].tobytes() and len(cut.q) == 320
    wanted = spark.createDataFrame([(f"file://{tmp_path}/{n}.wav", a, b) for n, a, b in (("a", 100, 200), ("b", 990, 5000), ("c", 500, 600), ("e", 0, 10), ("z", 0, 10))], "path string, start_ms long, end_ms long")
    got = {r.path[-5]: (None if r.pcm is None else bytes(r.pcm), r.error) for r in audio.regions(wanted).collect()}
    assert got == {"a": (x[1600:3200].tobytes(), None), "b": (x[15_840:].tobytes(), None), "c": (b"", None), "e": (None, "AUDIO_UNREADABLE"), "z": (None, "AUDIO_UNREADABLE")}
    clips = audio.rendered(wanted.filter("path like '%a.wav'")).select(F.lit("clips/a.wav").alias("path"), "content")
    listed = exports.write_files(clips, f"file://{tmp_path}/made").first()
    assert (tmp_path / "made/clips/a.wav").stat().st_size == listed.bytes and audio.pcm((tmp_path / "made/clips/a.wav").read_bytes()).tobytes() == x[1600:3200].tobytes()
    with pytest.raises(Exception, match="PATH_OUTSIDE_ROOT"):
        exports.write_files(clips.withColumn("path", F.lit("../x")), f"file://{tmp_path}/made")


def test_samples_as_numbers(spark):
    x = np.array([0, 1, -1, 32767, -32768, 256, -257], "<i2")
    r = spark.createDataFrame([(x.tobytes(),), (b"",)], "b binary").select(vx.int16_samples(F.col("b")).alias("v")).collect()
    assert r[0].v == (x / 32768).tolist() and r[1].v == []


def test_codecs(spark):
    ok = lambda codec, container: spark.range(1).select(documents.allowed(F.lit(codec), F.lit(container))).first()[0]
    assert ok("pcm_s16le", "wav") and ok("amr_nb", "mov,mp4,m4a") and ok("opus", "matroska,webm")
    assert not ok("alac", "mov,mp4") and not ok("wmav2", "asf") and not ok("mp3", "aiff")


def test_checked_documents(spark, tmp_path):
    good = {"schema_version": "voice_analysis_input_v1", "segments": [{"id": "a", "start_ms": 0, "end_ms": 5, "text": "x", "confidence": 0.5, "extra": 1}]}
    one = good["segments"][0]
    cases = {"good": good, "bare": {"segments": [one]}, "root": good | {"more": 1}, "version": good | {"schema_version": "v2"}, "none": good | {"segments": []}, "twice": good | {"segments": [one, one]}, "range": good | {"segments": [one | {"end_ms": 0}]}, "sure": good | {"segments": [one | {"confidence": 2}]}, "list": [1]}
    for name, doc in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "text.json").write_text("no JSON")
    got = {r.recording.rsplit("/", 1)[1][:-5]: r.error for r in documents.checked_documents(spark, f"file://{tmp_path}/*.json").collect()}
    assert {k for k, e in got.items() if e is None} == {"good", "bare"} and set(got.values()) == {None, "SEGMENTS_INVALID"}


def test_datasets_are_written_once(spark, tmp_path):
    rows = [("r_001", "src", 0, 5000, 0, 0, 900, 0, 900, "hi", "role", "speaker_a_overlap", "speaker_a", ["overlap_suffix_normalized"]), ("r_001", "src", 0, 5000, 1, 1000, 2000, 1000, 2000, "yo", "role", "speaker_b", "speaker_b", [])]
    made = exports.samples(spark.createDataFrame(rows, "sample_id string, source_id string, clip_start long, clip_end long, source_index int, start_ms long, end_ms long, source_start_ms long, source_end_ms long, text string, role string, raw_speaker string, speaker string, flags array<string>"), "weak_auto")
    tags = spark.createDataFrame([("r_001", ["two_speaker"])], "sample_id string, scenarios array<string>")
    clips = spark.createDataFrame([("r_001", b"RIFF")], "sample_id string, content binary")
    root = f"file://{tmp_path}/set"
    assert exports.write_dataset(made, tags, clips, "weak_auto", root).count() == 3
    document = json.loads((tmp_path / "set/samples/r_001/input.json").read_text())
    assert [s["id"] for s in document["segments"]] == ["r_001_seg_00000", "r_001_seg_00001"] and document["segments"][0]["reference_speaker"] == "speaker_a"
    line = json.loads(next((tmp_path / "set/manifest").glob("*.txt")).read_text())
    assert line["reference_path"] == "samples/r_001/reference.json" and line["scenarios"] == ["two_speaker"]
    with pytest.raises(ValueError, match="already exists"):
        exports.write_dataset(made, tags, clips, "weak_auto", root)
    assert exports.write_dataset(made, tags, clips, "weak_auto", root, force=True).count() == 3
    tasks = spark.createDataFrame([("0" * 32, "queued", None)], "task_id string, status string, stage string")
    exports.write_files(exports.task_files(tasks), f"file://{tmp_path}/tasks")
    assert [(r.task_id, r.status) for r in task_store.task_facts(spark, f"file://{tmp_path}/tasks").collect()] == [("0" * 32, "queued")]


@pytest.mark.parametrize(("url", "want"), [
    ("https://u:p@Host.COM:8080/x?a=1&api_key=2&b=c d#f", "https://host.com:8080/x?a=1&api_key=%3Credacted%3E&b=c+d#f"), ("http://h?x", "http://h?x="), ("http://[::1]:80/p", "http://[::1]:80/p"),
    ("http://h:x/", "<redacted-url>"), ("http://h:99999/", "<redacted-url>"), ("http://h/?", "http://h/"), ("http://h/?My_Token=%41*~&&y", "http://h/?My_Token=%3Credacted%3E&y="), ("http://h/?q=%41*~", "http://h/?q=A%2A~"),
])
def test_public_urls(spark, url, want):
    assert spark.range(1).select(tx.public_url(F.lit(url))).first()[0] == want


def test_profiles_and_configurations():
    p = params.timeline_of({"speech_window_candidate": {"edge_trim_ms": 0, "min_trimmed_ms": 900}, "clean_window": {"max_join_gap_ms": 700}})
    assert (p.edge_trim_ms, p.tiny_ms, p.join_gap_ms, p.low_ratio) == (200, 900, 700, 0.75)
    base = {"schema_version": 1, "algorithm": {"profile_id": "a"}, "runtime": {"temporary_root": "/t", "n": 1}}
    full = params.load_config(base, {"runtime": {"n": 2}})
    assert full["runtime"] == {"temporary_root": "/t", "n": 2}
    assert params.snapshot(full, lambda x: "shown")["runtime"] == "shown"
    for bad, overlay, code in ((base, {"algorithm": {}}, "LOCKED"), ({"schema_version": 2}, None, "INVALID")):
        with pytest.raises(ValueError, match=code):
            params.load_config(bad, overlay)


def test_long_recordings_stay_linear(spark):
    """Silence and batches of one long recording."""
    n = 60_000
    f = spark.range(n).selectExpr("1L recording_id", "id * 100 start_ms", "id * 100 + 100 end_ms", "int(id % 997 = 0) active", "'' dom")
    r = timeline.boundary_silence(f).selectExpr("sum(left_silence_ms) a", "sum(right_silence_ms) b", "max(left_silence_ms) m").first()
    assert r.m == 99_600 and r.a > 0 and r.b > 0
    w = spark.range(n).selectExpr("1L recording_id", "id place", "4000L duration_ms", "128000L n_bytes")
    assert packing.batches(w).selectExpr("max(batch) m", "count(1) n").first()[:] == (n // 15 - 1, n)


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.clock(F.lit(3_600_000 * 101 + 61_005)).alias("a"), tx.clock_ms(F.lit("01:02:03")).alias("b"), tx.without_overlap_suffix(F.lit("x_overlap_overlap")).alias("c"),
        tx.basename(F.lit("/a/b/")).alias("d"), tx.basename(F.lit("/")).alias("e"), tx.redacted("access_token", F.lit("q"), StringType()).alias("f"), tx.redacted("note", F.lit("C:\\x\\y"), StringType()).alias("g"), tx.is_task_id(F.lit("0" * 32)).alias("h"),
    ).first()
    assert tuple(row) == ("101:01:01.005", 3_723_000, "x", "b", "<path>", "<redacted>", "y", True)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, 0.0, 0.0, 0.0]


def test_exports(spark, tmp_path):
    df = seg(spark, [(0, 1500, "hi", None)]).withColumn("label", F.lit("local_spk_0")).withColumn("confidence", F.lit(0.5)).withColumn("risk_level", F.lit("low"))
    assert exports.txt(df, confidence=True, risk=True).first().content == "[00:00:00.000 - 00:00:01.500] [local_spk_0] [confidence=0.5000] [risk=low] hi\n"
    assert exports.srt(df).first().content == "1\n00:00:00,000 --> 00:00:01,500\n[local_spk_0] hi\n"
    assert exports.vtt(df).first().content == "WEBVTT\n\n00:00:00.000 --> 00:00:01.500\n[local_spk_0] hi\n"
    assert json.loads(exports.result_json(df).first().content)["segments"][0]["assignment"]["label"] == "local_spk_0"
    exports.write_texts(exports.vtt(df), f"file://{tmp_path}/out")
    assert next((tmp_path / "out" / "recording_id=1").glob("*.txt")).read_text().startswith("WEBVTT")


def test_params():
    assert params.merged({"a": {"x": 1, "y": 2}, "b": 3}, {"a": {"y": 5}}) == {"a": {"x": 1, "y": 5}, "b": 3}
    with pytest.raises(ValueError, match="locked"):
        params.merged({}, {"services": {}}, locked=("services",))
    assert params.Params().digest() == params.Params().digest() != params.Params(candidates=params.Candidates(max_join_gap_ms=1)).digest()


def test_task_states(spark):
    rows = [("t", "created", 0, 0), ("t", "started", 1, 1), ("t", "cancel_requested", 2, 2), ("t", "succeeded", 3, 3), ("t", "failed", 4, 4), ("u", "created", 0, 5), ("u", "cancel_requested", 1, 6), ("u", "started", 2, 7), ("v", "succeeded", 5, 8), ("v", "expired", 5 + 86_400_000, 9)]
    df = spark.createDataFrame(rows, "task_id string, event string, at_ms long, seq long")
    got = {r.task_id: (r.status, r.finished_at_ms) for r in sessions.task_states_batch(df).collect()}
    assert got == {"t": ("cancelled", 3), "u": ("cancelled", 1), "v": ("expired", 5)}
    loop = {}
    for task, event, at, _ in rows:
        loop[task] = sessions.next_state(loop.get(task), event, at)
    assert {k: (s["status"], s["finished_at_ms"]) for k, s in loop.items()} == got


def test_a_stream_ends_in_the_batch_states(spark):
    q = catalogue.queries()
    key = lambda name: sorted(map(str, q[name](spark, "/root/testdata/sf0.001").select("task_id", "status", "created_at_ms", "finished_at_ms", "cancel_requested", "n_events").toPandas().astype(object).where(lambda d: d.notna(), None).values.tolist()))
    assert key("stream_task_state") == key("task_state_batch")


def test_plans(spark):
    """The speaker column is not read for regions; joins with an equal key are no nested loops; shuffles don't change answers."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sf = "/root/testdata/sf0.001"
    assert "role" not in plan(windows.candidates(views.segments(spark, sf)))
    assert "NestedLoop" not in plan(catalogue.queries()["interval_overlap_join"](spark, sf)) and "Cartesian" not in plan(catalogue.queries()["recall_assignment"](spark, sf))
    a = windows.candidates(views.segments(spark, sf)).toPandas()
    b = windows.candidates(views.segments(spark, sf).repartition(13, "text")).toPandas()
    order = ["recording_id", "start_ms"]
    pd.testing.assert_frame_equal(a.sort_values(order).reset_index(drop=True), b.sort_values(order).reset_index(drop=True))
