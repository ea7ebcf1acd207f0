"""Segment documents, manifests and transcripts as DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions.text import clock_ms, without_overlap_suffix

SEGMENT = "struct<id: string, start_ms: bigint, end_ms: bigint, text: string, confidence: double, speaker: string>"
DOCUMENT = f"schema_version string, metadata map<string, string>, segments array<{SEGMENT}>"
MANIFEST = "id string, reference_path string, result_path string, audio_path string, segments_path string, scenarios array<string>, source_recording_id string, annotation_grade string"
#: What may be analysed, besides codecs that begin with pcm_.
CODECS = ("aac", "amr_nb", "amr_wb", "flac", "mp3", "opus", "vorbis")
CONTAINERS = ("3g2", "3gp", "aac", "amr", "flac", "m4a", "matroska", "mj2", "mov", "mp3", "mp4", "ogg", "wav", "wave", "webm")
#: Fixed value: the line before each segment of a transcript; other bold lines are text.
HEADING = r"(?m)^\*\*\[(\d{2}:\d{2}:\d{2})[–-](\d{2}:\d{2}:\d{2})\] (.+?) · (speaker_[A-Za-z0-9_]+)\*\*\s*$"
DECLARED = r"(?m)^- 转写段数：(\d+)\s*$"
AMBIGUOUS = "ASR混合|未分离"
#: The version of a segment document, and what its root may hold.
INPUT, ROOT = "voice_analysis_input_v1", ("schema_version", "segments", "metadata")


def checked_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document: recording (the file), body, error. SEGMENTS_INVALID: no JSON object, a root key or version that
    isn't known, no segment, or a segment that breaks a rule of its own (see windows.validated for all of them by name)."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("recording"), F.col("value").alias("body"))
    s = F.from_json("body", DOCUMENT)
    broken = F.exists(s["segments"], lambda x: x.isNull() | F.coalesce(x["id"] == "", F.lit(True)) | F.coalesce(x["start_ms"] < 0, F.lit(True)) | F.coalesce(x["end_ms"] <= x["start_ms"], F.lit(True)) | x["text"].isNull() | ~F.coalesce(x["confidence"].between(0, 1), F.lit(True)))
    ids = F.transform(s["segments"], lambda x: x["id"])
    keys = F.json_object_keys("body")
    fine = keys.isNotNull() & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in ROOT]))) == 0) & F.coalesce(F.coalesce(s["schema_version"], F.lit(INPUT)) == INPUT, F.lit(False))
    fine = fine & F.coalesce(F.size(s["segments"]) > 0, F.lit(False)) & ~F.coalesce(broken, F.lit(True)) & F.coalesce(F.size(F.array_distinct(ids)) == F.size(ids), F.lit(False))
    return rows.withColumn("error", F.when(~F.coalesce(fine, F.lit(False)), "SEGMENTS_INVALID"))


def segment_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment of each JSON document, in its arrival order: recording (the file), input_index, fields."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("recording", F.input_file_name())
    return rows.select("recording", "schema_version", F.posexplode("segments").alias("input_index", "s")).select("recording", "schema_version", "input_index", "s.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSONL manifest; blank lines are skipped. The first line of a file that is no JSON object, or whose id or
    reference_path is missing or empty, is EVALUATION_MANIFEST_INVALID with the line's number."""
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.posexplode(F.split("value", r"\r\n|[\n\r]")).alias("at", "line"))
    rows = lines.select("at", F.col("line").rlike(r"\S").alias("said"), F.json_object_keys("line").isNotNull().alias("object"), F.from_json("line", MANIFEST).alias("m"))
    there = lambda c: F.coalesce(F.col(f"m.{c}") != "", F.lit(False))
    message = F.concat(F.lit("EVALUATION_MANIFEST_INVALID: invalid manifest row "), (F.col("at") + 1).cast("string"))
    fine = F.assert_true(~F.col("said") | (F.coalesce(F.col("object"), F.lit(False)) & there("id") & there("reference_path")), message)
    return rows.filter(F.col("said") & fine.isNull()).select("m.*")


def contained(root: str, path: str) -> str:
    """path below root, resolved; an error if it leaves it."""
    full = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([os.path.realpath(root), full]) != os.path.realpath(root):
        raise ValueError("EVALUATION_PATH_OUTSIDE_ROOT")
    return full


def transcript(raw: DataFrame, text: str = "text", duration: str = "duration_ms") -> DataFrame:
    """Headings with their bodies, repaired: raw has recording_id, a transcript and its audio's length.

    A segment that doesn't end after its start gets 1000 ms; ends are clamped to the audio; segments that start beyond
    it, or have no length left, come back as dropped.
    """
    part = lambda k: F.regexp_extract_all(F.col(text), F.lit(HEADING), F.lit(k))
    bodies = F.slice(F.split(F.col(text), HEADING), 2, F.size(part(1)))
    rows = raw.select("recording_id", duration, F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("role"), part(4).alias("raw_speaker"), bodies.alias("body"))).alias("source_index", "h"))
    h = [F.col("h").getField(n) for n in ("a", "b", "role", "raw_speaker", "body")] if "a" in rows.schema["h"].dataType.names else [F.col("h").getField(str(i)) for i in range(5)]
    lines = F.filter(F.transform(F.split(h[4], r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = rows.select("recording_id", F.col(duration).alias("duration_ms"), "source_index", clock_ms(h[0]).alias("start_ms"), clock_ms(h[1]).alias("stated_end"), F.trim(h[2]).alias("role"), h[3].alias("raw_speaker"), without_overlap_suffix(h[3]).alias("speaker"), F.array_join(lines, "\n").alias("text"))
    short = F.col("stated_end") <= F.col("start_ms")
    end = F.when(short, F.least(F.col("duration_ms"), F.col("start_ms") + 1000)).otherwise(F.col("stated_end"))
    flags = F.array_compact(F.array(F.when(short, "zero_duration_expanded_to_1000ms"), F.when(end > F.col("duration_ms"), "end_clamped_to_audio"), F.when(F.col("speaker") != F.col("raw_speaker"), "overlap_suffix_normalized"), F.when(F.col("role").rlike(AMBIGUOUS), "ambiguous_semantic_role")))
    rows = rows.withColumn("flags", flags).withColumn("end_ms", F.least(end, F.col("duration_ms")))
    return rows.withColumn("dropped", F.when(F.col("start_ms") >= F.col("duration_ms"), "start_out_of_bounds").when(F.col("end_ms") <= F.col("start_ms"), "nonpositive_after_repair")).drop("stated_end")


def transcript_audit(raw: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """Per recording: the declared number of segments, those found, usable and dropped, and how many were repaired. rows: what
    transcript() gives for raw."""
    declared = raw.select("recording_id", F.nullif(F.regexp_extract(F.col(text), DECLARED, 1), F.lit("")).cast("long").alias("declared_segment_count"))
    kept = F.col("dropped").isNull()
    flagged = lambda name: F.count_if(kept & F.array_contains("flags", name))
    counts = rows.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("parsed_heading_count"), F.count_if(kept).alias("usable_segment_count"), F.count_if(~kept).alias("dropped_out_of_bounds_count"),
        F.count_if(F.col("dropped") == "start_out_of_bounds").alias("dropped_start_out_of_bounds_count"), F.count_if(F.col("dropped") == "nonpositive_after_repair").alias("dropped_nonpositive_after_repair_count"),
        flagged("zero_duration_expanded_to_1000ms").alias("zero_duration_repair_count"), flagged("overlap_suffix_normalized").alias("overlap_suffix_count"), flagged("ambiguous_semantic_role").alias("ambiguous_role_count"),
    )
    out = declared.join(counts, "recording_id", "left").na.fill(0, [c for c in counts.columns if c != "recording_id"])
    same = lambda c: F.coalesce(F.col("declared_segment_count") == F.col(c), F.lit(False))
    return out.withColumn("declared_count_matches", same("parsed_heading_count")).withColumn("usable_count_matches_declared", same("usable_segment_count"))


def normalised_asr(rows: DataFrame) -> DataFrame:
    """Sentences of a recogniser (recording_id, pos, begin_time/time or start_time/end_time, text, id) as segments."""
    start = F.coalesce("begin_time", "start_time", F.lit(0)).cast("long")
    rows = rows.withColumn("start_ms", start).withColumn("end_ms", F.coalesce("time", "end_time", F.col("start_ms")).cast("long"))
    number = F.row_number().over(Window.partitionBy("recording_id").orderBy("pos"))
    rows = rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("asr-"), number.cast("string"))))
    return rows.withColumn("violation", F.when((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")), "ASR_RESULT_INVALID")).select("recording_id", "id", "start_ms", "end_ms", "text", "violation")


def flattened_flash(docs: DataFrame, column: str = "body") -> DataFrame:
    """sentence_list of every flash_result of a JSON answer, in order."""
    kind = "flash_result array<struct<channel_id: bigint, sentence_list: array<struct<begin_time: bigint, end_time: bigint, text: string, speaker: string>>>>"
    rows = docs.select("recording_id", F.posexplode_outer(F.from_json(column, kind)["flash_result"]).alias("block", "r"))
    rows = rows.select("recording_id", "block", F.posexplode_outer("r.sentence_list").alias("at", "s")).filter("s is not null")
    return rows.select("recording_id", F.struct("block", "at").alias("pos"), "s.*")


def allowed(codec: Column, containers: Column) -> Column:
    """Whether both the codec and one of the comma-separated containers may be analysed."""
    return (codec.isin(*CODECS) | codec.startswith("pcm_")) & F.arrays_overlap(F.split(containers, ","), F.array(*[F.lit(c) for c in CONTAINERS]))
