"""The whole way from segments to a report, on recordings whose right answer is known."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from voxframe.plans import analysis
from voxframe.sources import exports

#: Per recording a dialogue of two speakers in turns of 6 s; a turn's vector points along its speaker's axis.
TURN, TURNS = 6000, 8


@pytest.fixture(scope="module")
def tables(spark):
    segments, frames, power = [], [], []
    for rec in (1, 2, 3):
        for t in range(TURNS):
            at = t * (TURN + 1000)
            segments.append((rec, t, at, at + TURN, f"turn {t}", 0.5, "not read"))
            frames += [(rec, at + k * 100, at + k * 100 + 100, 1, f"speaker_{t % 2}") for k in range(TURN // 100)]
            frames += [(rec, at + TURN + k * 100, at + TURN + k * 100 + 100, 0, "") for k in range(10)]
        power += [(rec, k * 30, k * 30 + 30, 4_000_000.0 if k * 30 % (TURN + 1000) < TURN else 0.0) for k in range(TURNS * (TURN + 1000) // 30)]
        segments.append((rec, TURNS, TURNS * (TURN + 1000), TURNS * (TURN + 1000) + 700, "short", None, None))
    return (
        spark.createDataFrame(segments, "recording_id long, input_index long, start_ms long, end_ms long, text string, confidence double, speaker string"),
        spark.createDataFrame(frames, "recording_id long, start_ms long, end_ms long, active int, dom string"),
        spark.createDataFrame(power, "recording_id long, start_ms long, end_ms long, power double"),
    )


def embed(requests):
    """Recording 2 loses one vector, recording 3 all."""
    turn = F.floor(F.col("start_ms") / (TURN + 1000))
    near = F.lit(0.02) * (F.col("start_ms") % 7)
    vector = F.when(turn % 2 == 0, F.array(F.lit(1.0), near, F.lit(0.0))).otherwise(F.array(near, F.lit(0.0), F.lit(1.0)))
    lost = (F.col("recording_id") == 3) | ((F.col("recording_id") == 2) & (F.col("request") == "sentence:3"))
    return requests.select("recording_id", "request", F.when(lost, "inference_failed").otherwise("success").alias("status"), F.when(~lost, vector).alias("embedding"))


@pytest.fixture(scope="module")
def found(tables):
    return analysis.analyze(*tables, embed)


def test_segments_go_to_their_speakers(found):
    rows = {(r.recording_id, r.input_index): r for r in found.segments.collect()}
    assert len(rows) == 3 * (TURNS + 1)
    for t in range(TURNS):
        assert rows[1, t].label == f"local_spk_{t % 2}" and rows[1, t].risk_level == "low" and rows[1, t].confidence > 0.8
        assert rows[3, t].label == "unknown"
    assert (rows[2, 3].label, rows[2, 3].reason) == ("unknown", "missing_segment_embedding")
    assert (rows[1, TURNS].label, rows[1, TURNS].reason) == ("unknown", "missing_segment_embedding")


def test_failures_stay_with_their_recording(found):
    rows = {r.recording_id: (r.status, r.error) for r in found.recordings.collect()}
    assert rows == {1: ("success", None), 2: ("partial", None), 3: ("failed", "VOICE_EMBEDDING_ALL_WINDOWS_FAILED")}
    assert {r.recording_id: r.n for r in found.speakers.groupBy("recording_id").agg(F.count("*").alias("n")).collect()} == {1: 2, 2: 2}
    audit = {r.recording_id: (r.segment_count, r.assigned_count) for r in found.audit.collect()}
    assert audit == {1: (TURNS + 1, TURNS), 2: (TURNS + 1, TURNS - 1), 3: (TURNS + 1, 0)}


def test_candidates_that_fail_spoil_no_other(tables, spark):
    failures = spark.createDataFrame([(1, "asr_candidate_000", "RuntimeError")], "recording_id long, candidate_id string, error string")
    got = analysis.analyze(*tables, embed, failures)
    assert {r.recording_id: r.failed_candidates for r in got.recordings.collect()} == {1: 1, 2: 0, 3: 0}
    assert {r.label for r in got.segments.filter("recording_id = 1 and input_index < 8").collect()} == {"local_spk_0", "local_spk_1"}


def test_exports_say_what_the_segments_say(found):
    text = exports.txt(found.segments).filter("recording_id = 1").first().content.splitlines()
    assert text[0] == "[00:00:00.000 - 00:00:06.000] [local_spk_0] turn 0" and text[-1].endswith("[unknown] short")


def test_a_clip_is_embedded_once(tables):
    segments = tables[0].filter("recording_id = 1 and input_index < 2")
    gold = segments.select("recording_id", F.col("input_index").alias("vec_id"), F.lit("w").alias("window_id"), "start_ms", "end_ms")
    seen = []

    def once(requests):
        seen.append(sorted(r.request for r in requests.collect()))
        return embed(requests).filter("request <> 'sentence:1'")

    rows = {r.request: (r.canonical, r.status) for r in analysis.vectors_of(analysis.requested(segments, gold), once).collect()}
    assert seen == [["sentence:0", "sentence:1"]]
    assert rows == {"sentence:0": ("sentence:0", "success"), "gold:0:w": ("sentence:0", "success"), "sentence:1": ("sentence:1", "missing_result"), "gold:1:w": ("sentence:1", "missing_result")}


def test_report(found, tables, spark):
    reference = tables[0].filter("input_index < 8").select("recording_id", "input_index", "start_ms", "end_ms", F.when(F.col("input_index") % 2 == 0, "anna").otherwise("ben").alias("speaker"))
    manifest = spark.createDataFrame(
        [(1, "a", "gold", None, None, ["two_speaker"], 60_000), (2, "a", "gold", "b", None, ["two_speaker"], 60_000), (4, None, None, None, None, ["overlap"], 60_000)],
        "recording_id long, source string, grade string, reference_source string, reference_grade string, scenarios array<string>, duration_ms long",
    )
    r = analysis.evaluated(manifest, reference, found.segments).first()
    assert r.status == "insufficient_dataset"
    assert (r.dataset.recording_count, r.dataset.scored_recording_count, r.dataset.independent_recording_count, r.dataset.scenario_counts) == (3, 1, 1, {"two_speaker": 2, "overlap": 1})
    assert r.metrics["der"] == 0 and r.metrics["assigned_accuracy"] == 1 and r.metrics["speaker_count_exact"] == 1


def test_from_answers_to_documents(tables, spark):
    """Recording 3 loses all vectors, 4 has no sentence, 5 one that ends before it starts, 6 is cancelled meanwhile."""
    sentences = lambda rows: json.dumps({"flash_result": [{"channel_id": 0, "sentence_list": [{"begin_time": r.start_ms, "end_time": r.end_ms, "text": r.text} for r in rows]}]})
    said = {k: sorted((r for r in tables[0].filter(F.col("recording_id") == k).collect()), key=lambda r: r.start_ms) for k in (1, 2, 3)}
    answers = [(1, sentences(said[1]), '{"provider":"x"}', False), (2, sentences(said[2]), None, None), (3, sentences(said[3]), None, False), (4, json.dumps({"flash_result": []}), None, False), (6, sentences(said[1]), None, True)]
    answers.append((5, json.dumps({"flash_result": [{"sentence_list": [{"begin_time": 9, "end_time": 5, "text": "x"}]}]}), None, False))
    df = spark.createDataFrame(answers, "recording_id long, body string, source string, cancelled boolean")
    rows = {r.recording_id: (r.status, r.result_status, r.content and json.loads(r.content)) for r in analysis.executed(df, tables[1], tables[2], embed).collect()}
    assert {k: r[:2] for k, r in rows.items()} == {1: ("succeeded", "success"), 2: ("succeeded", "partial"), 3: ("failed", None), 4: ("failed", None), 5: ("failed", None), 6: ("cancelled", None)}
    assert rows[1][2]["transcript_source"] == {"provider": "x"} and "transcript_source" not in rows[2][2] and rows[6][2] is None
    assert [s["assignment"]["label"] for s in rows[1][2]["segments"]] == [*[f"local_spk_{t % 2}" for t in range(TURNS)], "unknown"]
    assert {k: (rows[k][2]["error"]["code"], rows[k][2]["error"]["stage"], rows[k][2]["error"]["retryable"]) for k in (3, 4, 5)} == {
        3: ("VOICE_EMBEDDING_ALL_WINDOWS_FAILED", "voice_embedding", True), 4: ("ASR_EMPTY_RESULT", "transcribing", False), 5: ("ASR_RESULT_INVALID", "transcribing", False),
    }


def test_a_union_gives_each_clip_one_vector(spark):
    """Both sides of the union come from windows over recordings, so Spark has them partitioned alike."""
    kept = spark.conf.get("spark.sql.unionOutputPartitioning")
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    try:
        base = spark.createDataFrame([(1, 7000 * k, 7000 * k + 6000) for k in range(8)], "recording_id long, start_ms long, end_ms long")
        numbered = lambda name: F.row_number().over(Window.partitionBy("recording_id").orderBy("start_ms")).cast("long").alias(name)
        segments = base.select("recording_id", numbered("input_index"), "start_ms", "end_ms")
        gold = base.select("recording_id", numbered("vec_id"), F.lit("w").alias("window_id"), "start_ms", "end_ms")
        assert analysis.vectors_of(analysis.requested(segments, gold), embed).count() == 16
    finally:
        spark.conf.set("spark.sql.unionOutputPartitioning", kept)
