"""Transcripts as text, subtitles and JSON. Rows: recording_id, input_index, start_ms, end_ms, text, label, and for the
options confidence, reason, risk_level."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.text import clock
from voxframe.operators.intervals import KEY


#: The formats' names.
RESULT, FAILURE, REFERENCE, INPUT = "voice_analysis_result_v1", "voice_analysis_failure_v1", "voice_analysis_reference_v1", "voice_analysis_input_v1"


def prefix(confidence: bool = False, reason: bool = False, risk: bool = False) -> Column:
    parts = [F.concat(F.lit("["), F.col("label"), F.lit("]"))]
    if confidence:
        parts.append(F.format_string("[confidence=%.4f]", F.coalesce("confidence", F.lit(0.0))))
    if reason:
        parts.append(F.concat(F.lit("[reason="), F.coalesce("reason", F.lit("")), F.lit("]")))
    if risk:
        parts.append(F.concat(F.lit("[risk="), F.coalesce("risk_level", F.lit("")), F.lit("]")))
    return F.concat_ws(" ", *parts)


def _whole(rows: DataFrame, line: Column, head: str, join: str, tail: str) -> DataFrame:
    """One text per recording, of its lines in time order."""
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "input_index", line.alias("line"))))
    return rows.groupBy(KEY).agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda x: x["line"]), join), F.lit(tail)).alias("content"))


def txt(rows: DataFrame, **options: bool) -> DataFrame:
    line = F.concat(F.lit("["), clock(F.col("start_ms")), F.lit(" - "), clock(F.col("end_ms")), F.lit("] "), prefix(**options), F.lit(" "), F.col("text"))
    return _whole(rows, line, "", "\n", "\n")


def _cue(point: str, options: dict) -> Column:
    return F.concat(clock(F.col("start_ms"), point), F.lit(" --> "), clock(F.col("end_ms"), point), F.lit("\n"), prefix(**options), F.lit(" "), F.col("text"), F.lit("\n"))


def srt(rows: DataFrame, **options: bool) -> DataFrame:
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy(KEY).orderBy("start_ms", "input_index")))
    return _whole(numbered, F.concat(F.col("n").cast("string"), F.lit("\n"), _cue(",", options)), "", "\n", "")


def vtt(rows: DataFrame, **options: bool) -> DataFrame:
    return _whole(rows, _cue(".", options), "WEBVTT\n\n", "\n", "")


def result_json(rows: DataFrame) -> DataFrame:
    """One result document per recording; fields without a value are left out."""
    segment = F.struct(F.col("input_index"), F.struct("start_ms", "end_ms", "text").alias("normalized"), F.struct("label").alias("assignment"))
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "input_index", segment.alias("segment"))))
    body = F.to_json(F.struct(F.lit(RESULT).alias("schema_version"), F.transform(F.first("all"), lambda x: x["segment"]).alias("segments")), {"ignoreNullFields": "true"})
    return rows.groupBy(KEY).agg(ordered.alias("all")).groupBy(KEY).agg(body.alias("content"))


SEGMENTS = "struct<segments: array<struct<input_index: bigint, normalized: struct<start_ms: bigint, end_ms: bigint, text: string>, assignment: struct<label: string>>>>"


def from_result(results: DataFrame) -> DataFrame:
    """The rows of result documents (recording_id, content), so that every other format says what the document says."""
    rows = results.select(KEY, F.explode(F.from_json("content", SEGMENTS)["segments"]).alias("s"))
    return rows.select(KEY, "s.input_index", "s.normalized.*", F.col("s.assignment.label").alias("label"))


def failures(errors: DataFrame) -> DataFrame:
    """Failure documents of recordings (recording_id, code, stage, message, retryable)."""
    body = F.struct(F.lit(FAILURE).alias("schema_version"), F.lit("failed").alias("status"), F.struct("code", "stage", "message", "retryable").alias("error"))
    return errors.select(KEY, F.to_json(body).alias("content"))


def with_source(documents: DataFrame, source: Column) -> DataFrame:
    """Result documents with transcript_source (a JSON text) at their root; others, where it is null, stay as they are."""
    body = F.concat(F.regexp_replace("content", r"\}\s*$", ""), F.when(F.size(F.json_object_keys("content")) > 0, ",").otherwise(""), F.lit('"transcript_source":'), source, F.lit("}"))
    return documents.withColumn("content", F.when(source.isNotNull(), body).otherwise(F.col("content")))


def canonical(documents: DataFrame, column: str = "document", most: int = 16 << 20) -> DataFrame:
    """A struct column as compact JSON (column content), fields without a value left out; error is SEGMENTS_TOO_LARGE and content
    null beyond `most` bytes."""
    rows = documents.withColumn("content", F.to_json(F.col(column), {"ignoreNullFields": "true"})).drop(column)
    large = F.octet_length("content") > most
    return rows.withColumn("error", F.when(large, "SEGMENTS_TOO_LARGE")).withColumn("content", F.when(~large, F.col("content")))


def samples(segments: DataFrame, grade: str) -> DataFrame:
    """Per sample its input and reference document, its facts, and whether it is valid.

    segments: sample_id, source_id, clip_start, clip_end, source_index, start_ms, end_ms (within the clip), source_start_ms,
    source_end_ms, text, role, raw_speaker, speaker, flags.
    """
    name = F.format_string("%s_seg_%05d", "sample_id", "source_index")
    order = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("source_index", x.alias("x")))), lambda r: r["x"])
    own = F.struct(
        name.alias("id"), "start_ms", "end_ms", "text", F.col("raw_speaker").alias("speaker"), F.col("source_id").alias("source_recording_id"), F.col("source_index").alias("source_segment_index"), "source_start_ms", "source_end_ms",
        F.col("role").alias("semantic_role"), F.col("speaker").alias("reference_speaker"), F.lit(grade).alias("annotation_grade"), F.col("flags").alias("annotation_flags"),
    )
    truth = F.struct(name.alias("id"), "start_ms", "end_ms", "speaker", F.col("role").alias("semantic_role"), "raw_speaker", F.lit(grade).alias("annotation_grade"), F.col("flags").alias("annotation_flags"))
    key = ["sample_id", "source_id", "clip_start", "clip_end"]
    flagged = lambda f: F.count_if(F.array_contains("flags", f))
    rows = segments.groupBy(*key).agg(
        order(own).alias("own"), order(truth).alias("truth"), F.count(F.lit(1)).alias("segment_count"), F.count_distinct("speaker").alias("speaker_count"),
        flagged("zero_duration_expanded_to_1000ms").alias("zero_duration_repair_count"), flagged("overlap_suffix_normalized").alias("overlap_suffix_count"), flagged("ambiguous_semantic_role").alias("ambiguous_role_count"),
        F.bool_and((F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("end_ms")) & (F.col("end_ms") <= F.col("clip_end") - F.col("clip_start"))).alias("valid"),
    )
    clip = [F.col("source_id").alias("source_recording_id"), F.col("clip_start").alias("source_clip_start_ms"), F.col("clip_end").alias("source_clip_end_ms")]
    document = F.struct(F.lit(INPUT).alias("schema_version"), F.struct("sample_id", *clip, F.lit(grade).alias("annotation_grade")).alias("metadata"), F.col("own").alias("segments"))
    reference = F.struct(F.lit(REFERENCE).alias("schema_version"), F.lit(grade).alias("annotation_grade"), F.struct(*clip, F.lit(False).alias("human_identity_verified")).alias("provenance"), F.col("truth").alias("segments"))
    return rows.withColumn("input", F.to_json(document)).withColumn("reference", F.to_json(reference)).drop("own", "truth")


def manifest_lines(made: DataFrame, scenarios: DataFrame, grade: str) -> DataFrame:
    """A dataset's manifest as text lines. made: samples(); scenarios: sample_id, scenarios."""
    path = lambda name: F.concat(F.lit("samples/"), F.col("sample_id"), F.lit(f"/{name}"))
    line = F.struct(F.col("sample_id").alias("id"), F.col("source_id").alias("source_recording_id"), F.lit(grade).alias("annotation_grade"), path("audio.wav").alias("audio_path"), path("input.json").alias("segments_path"), path("reference.json").alias("reference_path"), "scenarios")
    return made.join(scenarios, "sample_id").select("sample_id", F.to_json(line).alias("value"))


def write_dataset(made: DataFrame, scenarios: DataFrame, clips: DataFrame, grade: str, root: str, force: bool = False) -> DataFrame:
    """Write a dataset below root: samples/<id>/input.json, reference.json and audio.wav, and a manifest. clips: sample_id,
    content. A root that exists is an error unless force is set: then it stays until the new one is whole, and is put in its
    place. Gives the files that were written."""
    system, name = fs.FileSystem.from_uri(root.rstrip("/"))
    old = system.get_file_info(name).type != fs.FileType.NotFound
    if old and not force:
        raise ValueError(f"output already exists: {root}")
    mark = uuid.uuid4().hex
    made_at, name = f"{root.rstrip('/')}.{mark}.new", name.rstrip("/")
    at = lambda end: F.concat(F.lit("samples/"), F.col("sample_id"), F.lit(f"/{end}")).alias("path")
    files = clips.select(at("audio.wav"), "content")
    for end in ("input", "reference"):
        files = files.unionByName(made.select(at(f"{end}.json"), F.encode(end, "utf-8").alias("content")))
    schema = write_files(files, made_at).schema
    manifest_lines(made, scenarios, grade).orderBy("sample_id").select("value").write.mode("overwrite").text(f"{made_at}/manifest")
    if old:
        system.move(name, f"{name}.{mark}.old")
    system.move(f"{name}.{mark}.new", name)
    if old:
        system.delete_dir(f"{name}.{mark}.old")
    listed = next(i.path for i in system.get_file_info(fs.FileSelector(name)) if i.base_name.startswith("_written-"))
    return files.sparkSession.read.schema(schema).parquet(f"{root.rstrip('/')}/{listed.rsplit('/', 1)[1]}")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each row's content (binary) to its path below root, under another name first, so that no reader sees half a file
    and a task that runs again replaces what it wrote. Gives path, bytes, sha256; a path that leaves root is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root)
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError("PATH_OUTSIDE_ROOT")
                target = f"{base}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, target)
            yield pd.DataFrame({"path": frame["path"], "bytes": frame["content"].map(len), "sha256": frame["content"].map(lambda c: hashlib.sha256(c).hexdigest())})

    listed = f"{root.rstrip('/')}/_written-{uuid.uuid4().hex}"
    files.select("path", "content").mapInPandas(run, "path string, bytes long, sha256 string").write.parquet(listed)
    return files.sparkSession.read.parquet(listed)


def task_files(tasks: DataFrame) -> DataFrame:
    """Task facts as files <task_id>/task.json (path, content), for write_files()."""
    return tasks.select(F.concat("task_id", F.lit("/task.json")).alias("path"), F.encode(F.to_json(F.struct(*tasks.columns), {"ignoreNullFields": "true"}), "utf-8").alias("content"))


def write_texts(texts: DataFrame, path: str) -> None:
    """A file set with one folder per recording; the commit protocol makes it visible at once."""
    texts.select(KEY, F.col("content").alias("value")).write.mode("overwrite").partitionBy(KEY).text(path)
