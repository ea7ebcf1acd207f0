"""From segments to attributed segments, and from attributed segments to a report: the operators in their order.

All recordings run in one plan. What comes of models is a parameter: activity frames as a DataFrame, vectors as a function
of the windows that need one. Vectors and clusters are written to the shared folder, as several operators read them: a
model is called once, and a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators import assign, clusters, evaluate, requests, timeline, windows
from voxframe.operators.intervals import KEY, overlap_join
from voxframe.params import Params
from voxframe.shared import publish, scratch, steady
from voxframe.sources import documents, exports


@dataclass(frozen=True)
class Analysis:
    """segments: the input's columns (but speaker) and label, confidence, reason, risk_level, assignment; speakers: a row per
    local speaker; windows: scored; candidates: status by candidate; recordings: status, error and failures by recording;
    audit: counts of the assignment by recording."""

    segments: DataFrame
    speakers: DataFrame
    windows: DataFrame
    candidates: DataFrame
    recordings: DataFrame
    audit: DataFrame


def requested(segments: DataFrame, gold: DataFrame, p: Params = Params()) -> DataFrame:
    """Windows that need a vector: recording_id, request, kind, vec_id, start_ms, end_ms, clip_end, place. Sentences are segments of
    at least min_inference_ms (vec_id: their input_index), then gold windows, numbered in order."""
    sentence = segments.filter(F.col("end_ms") - F.col("start_ms") >= p.candidates.min_inference_ms)
    sentence = sentence.select(KEY, F.concat(F.lit("sentence:"), F.col("input_index").cast("string")).alias("request"), F.lit("sentence").alias("kind"), F.col("input_index").cast("long").alias("vec_id"), "start_ms", "end_ms", F.struct(F.lit(0).alias("kind"), F.col("start_ms").alias("at"), F.col("input_index").cast("long").alias("n")).alias("place"))
    named = F.concat(F.lit("gold:"), F.col("vec_id").cast("string"), F.lit(":"), F.col("window_id"))
    window = gold.select(KEY, named.alias("request"), F.lit("gold").alias("kind"), "vec_id", "start_ms", "end_ms", F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("at"), F.col("vec_id").alias("n")).alias("place"))
    steady(segments.sparkSession)
    rows = sentence.unionByName(window)
    return rows.withColumn("clip_end", F.least("end_ms", F.col("start_ms") + p.candidates.max_clip_ms))


def vectors_of(wanted: DataFrame, embed: Callable[[DataFrame], DataFrame], p: Params = Params()) -> DataFrame:
    """wanted with status and embedding: each clip is embedded once, whoever wants it; what embed doesn't give is
    missing_result. embed: (recording_id, request, kind, start_ms, end_ms) -> recording_id, request, status, embedding."""
    once = windows.deduplicated(wanted, p.candidates, "place")
    found = embed(once.select(KEY, "request", "kind", "start_ms", F.col("clip_end").alias("end_ms"))).select(KEY, "request", "status", F.col("embedding").cast("array<double>").alias("embedding"))
    clip = [KEY, "start_ms", "clip_end"]
    rows = wanted.join(once.select(*clip, F.col("request").alias("canonical")), clip)
    rows = rows.join(found.withColumnRenamed("request", "canonical"), [KEY, "canonical"], "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("missing_result"))).withColumn("embedding", F.when(F.col("status") == "success", F.col("embedding")))


def segment_quality(segments: DataFrame, power: DataFrame, p: Params = Params()) -> DataFrame:
    """recording_id, input_index, speech_ratio, loudness_db, loudness_std_db over the power frames that lie within each segment."""
    heard = overlap_join(power.select(KEY, "start_ms", "end_ms", "power"), segments.select(KEY, "input_index", "start_ms", "end_ms"))
    return timeline.loudness(heard.filter("start_ms >= right_start_ms and end_ms <= right_end_ms"), (KEY, "input_index"), p=p.timeline)


def analyze(segments: DataFrame, frames: DataFrame, power: DataFrame, embed: Callable[[DataFrame], DataFrame], failures: DataFrame | None = None, p: Params = Params()) -> Analysis:
    """Attribute the segments of every recording to local speakers.

    segments: recording_id (long), input_index, start_ms, end_ms, text, confidence and more columns; a speaker column is never
    read. frames: recording_id, start_ms, end_ms, active, dom. power: recording_id, start_ms, end_ms, power in frames of
    30 ms. failures: candidates whose frames could not be had (recording_id, candidate_id, error); they spoil no other.
    A recording is partial if some of its candidates or vectors failed, failed (with a code) if all of one kind did. Without
    speakers all its segments are unknown, which is a success. Failed recordings keep their rows, as unknown.
    """
    spark = segments.sparkSession
    work = scratch(spark, "analysis")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{work}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{work}/{name}")

    segments = kept(segments, "segments")  # read many times
    regions = kept(windows.candidates(segments, p.candidates), "candidates")
    built = timeline.built(regions, frames, power, p.timeline, kept)
    if failures is not None:
        built = built.join(failures.select(KEY, "candidate_id"), [KEY, "candidate_id"], "left_anti")
    scored = kept(windows.gold(windows.scored(built, p.scoring), p.scoring), "windows")
    results = timeline.candidate_results(regions, scored, failures)
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("candidate_id", "raw_start_ms")).cast("long") - 1
    gold = scored.filter("skip_reason is null").withColumn("vec_id", number)
    found = kept(vectors_of(requested(segments, gold, p), embed, p), "vectors")

    mine = found.filter("kind = 'gold'").select(KEY, "vec_id", "embedding").join(gold.select(KEY, "vec_id", "weight", "start_ms", "duration_ms", "loudness_db"), [KEY, "vec_id"])
    labels = kept(clusters.speakers(mine, p.clusters), "labels")
    anchors = clusters.anchors(mine.join(labels.select(KEY, "vec_id", "label"), [KEY, "vec_id"]), p.clusters)
    anchors = kept(clusters.relabelled(anchors, ("first_start_ms", "first_id")).drop("label").withColumnRenamed("local_label", "label"), "anchors")

    said = found.filter("kind = 'sentence'").select(KEY, F.col("vec_id").alias("input_index"), "embedding")
    rows = segments.select(KEY, F.col("input_index").cast("long").alias("input_index"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    rows = assign.with_quality(rows, segment_quality(segments, power, p)).join(said, [KEY, "input_index"], "left").withColumnRenamed("input_index", "vec_id")
    # A segment without a frame of sound has a ratio and deviation of 0.
    rows = rows.na.fill(0.0, ["speech_ratio", "loudness_std_db"])
    assigned = kept(assign.recalled(assign.strict(assign.top_two(rows, anchors, p.clusters), p.assignment), p.assignment), "assigned")
    made = assign.records(assigned).withColumnRenamed("vec_id", "input_index")
    own = [c for c in segments.columns if c not in ("speaker", "confidence")]
    out = segments.select(*own).withColumn("input_index", F.col("input_index").cast("long")).join(made, [KEY, "input_index"])
    out = out.select(*own, F.col("assignment.label").alias("label"), F.col("assignment.confidence").alias("confidence"), F.col("assignment.reason").alias("reason"), F.col("assignment.risk.level").alias("risk_level"), "assignment")

    failed = F.count_if(F.col("status") == "inference_failed")
    per_candidate = results.groupBy(KEY).agg(F.count(F.lit(1)).alias("candidates"), failed.alias("failed_candidates"))
    per_vector = found.groupBy(KEY).agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("embedding").isNull()).alias("failed_vectors"))
    recordings = per_candidate.join(per_vector, KEY, "left").na.fill(0)
    error = F.when((F.col("candidates") > 0) & (F.col("failed_candidates") == F.col("candidates")), "WINDOW_REFINE_ALL_CANDIDATES_FAILED").when((F.col("vectors") > 0) & (F.col("failed_vectors") == F.col("vectors")), "VOICE_EMBEDDING_ALL_WINDOWS_FAILED")
    status = F.when(error.isNotNull(), "failed").when(F.col("failed_candidates") + F.col("failed_vectors") > 0, "partial").otherwise("success")
    return Analysis(out, anchors, scored, results, recordings.select(KEY, status.alias("status"), error.alias("error"), "failed_candidates", "failed_vectors"), assign.audit(assigned))


#: What failure documents say, by code: stage, message, whether to try again.
ERRORS = {
    "ASR_EMPTY_RESULT": ("transcribing", "ASR provider returned no timed segments", False),
    "ASR_RESULT_INVALID": ("transcribing", "ASR provider returned an invalid time line", False),
    "WINDOW_REFINE_ALL_CANDIDATES_FAILED": ("window_refine", "all window-refine candidates failed", True),
    "VOICE_EMBEDDING_ALL_WINDOWS_FAILED": ("voice_embedding", "all embedding windows failed", True),
}


def transcribed(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, errors) of recognisers' answers (recording_id, body): segments of recordings whose time line is whole, numbered in
    order; recording_id and code of the others."""
    columns = {"start_time": "long", "time": "long", "id": "string"}
    flat = documents.flattened_flash(answers)
    rows = documents.normalised_asr(flat.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()}))
    rows = publish(rows, scratch(answers.sparkSession, "transcribed"))
    state = rows.groupBy(KEY).agg(F.max(F.col("violation")).alias("violation"))
    errors = answers.select(KEY).join(state.withColumn("said", F.lit(True)), KEY, "left")
    errors = errors.select(KEY, F.when(F.col("said").isNull(), "ASR_EMPTY_RESULT").otherwise(F.col("violation")).alias("code")).filter("code is not null")
    order = Window.partitionBy(KEY).orderBy("start_ms", "end_ms", "id")
    segments = rows.join(errors, KEY, "left_anti").select(KEY, (F.row_number().over(order) - 1).cast("long").alias("input_index"), "id", "start_ms", "end_ms", "text", F.lit(None).cast("double").alias("confidence"))
    return segments, errors


def executed(answers: DataFrame, frames: DataFrame, power: DataFrame, embed: Callable[[DataFrame], DataFrame], failures: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """From recognisers' answers to what tasks end with: recording_id, status (succeeded, failed, cancelled), result_status,
    content. A result document says where its transcript comes from; a failure document has code, stage and message; a
    cancelled recording has neither.

    answers: recording_id, body (the recogniser's JSON), source (a JSON text or null), cancelled (asked for meanwhile).
    """
    segments, errors = transcribed(answers)
    found = analyze(segments, frames, power, embed, failures, p)
    failed = errors.unionByName(found.recordings.filter("error is not null").select(KEY, F.col("error").alias("code")))
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for code, e in ERRORS.items() for x in (code, e[k])]), F.col("code"))
    told = exports.failures(failed.select(KEY, "code", of(0).alias("stage"), of(1).alias("message"), of(2).alias("retryable"))).withColumn("status", F.lit("failed"))
    whole = exports.result_json(found.segments.join(failed, KEY, "left_anti"))
    whole = exports.with_source(whole.join(answers.select(KEY, "source"), KEY), F.col("source")).select(KEY, "content", F.lit("succeeded").alias("status"))
    rows = told.unionByName(whole).join(found.recordings.select(KEY, F.col("status").alias("result_status")), KEY, "left").join(answers.select(KEY, "cancelled"), KEY)
    stopped = F.coalesce("cancelled", F.lit(False))
    return rows.select(KEY, F.when(stopped, "cancelled").otherwise(F.col("status")).alias("status"), F.when(~stopped & (F.col("status") == "succeeded"), F.col("result_status")).alias("result_status"), F.when(~stopped, F.col("content")).alias("content"))


def evaluated(manifest: DataFrame, reference: DataFrame, hypothesis: DataFrame, p: Params = Params()) -> DataFrame:
    """The report on a dataset, one row.

    manifest: recording_id, source, grade, reference_source, reference_grade, scenarios, duration_ms; reference: recording_id,
    start_ms, end_ms, speaker; hypothesis: segments of analyze(). A recording without a reference or a hypothesis, or whose
    provenance is given twice and unlike, is failed; it still counts for the dataset's scenarios.
    """
    steady(manifest.sparkSession)
    known = requests.provenance(manifest.select(F.col(KEY).alias("id"), "source", "grade", "reference_source", "reference_grade"))
    present = lambda rows, name: rows.select(F.col(KEY).alias("id"), F.lit(True).alias(name)).distinct()
    rows = manifest.select(F.col(KEY).alias("id"), "scenarios", "duration_ms").join(known, "id").join(present(reference, "has_reference"), "id", "left").join(present(hypothesis, "has_hypothesis"), "id", "left")
    fine = F.col("error").isNull() & F.coalesce("has_reference", F.lit(False)) & F.coalesce("has_hypothesis", F.lit(False))
    readable = F.col("error").isNull() & F.coalesce("has_reference", F.lit(False))
    rows = rows.select("id", F.when(fine, "scored").otherwise("failed").alias("status"), F.when(readable, F.col("source")).alias("source"), F.coalesce("grade", F.lit("")).alias("grade"), "scenarios", "duration_ms")
    scored = rows.filter("status = 'scored'").select(F.col("id").alias(KEY))
    r, h = reference.join(scored, KEY, "left_semi"), hypothesis.join(scored, KEY, "left_semi")
    metrics = evaluate.recording_metrics(r, h, evaluate.mapping(r, h, p.evaluation), p.evaluation)
    return evaluate.report(rows, metrics, p.evaluation)
