"""Checks, statuses and ordering of inference requests and their answers, and small per-recording views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.intervals import KEY, overlap_join

#: The columns of a task that are shown.
PUBLIC = ("schema_version", "task_id", "status", "stage", "result_status", "created_at_ms", "updated_at_ms", "started_at_ms", "finished_at_ms", "expired_at_ms", "error", "input_mode", "transcript_source", "asr_provider")


def embed_status(windows: DataFrame, total_bytes: Column, min_ms: int = 400, max_ms: int = 30_000, rate: int = 16_000) -> DataFrame:
    """Adds status (a window's own, so that a bad one spoils no other) and samples, at most max_ms of them. windows: offset and
    length in bytes of 16-bit samples."""
    n = F.floor(F.col("length") / 2)
    status = F.when((F.col("offset") < 0) | (F.col("offset") + F.col("length") > total_bytes), "invalid_boundary").when(n < min_ms * rate // 1000, "too_short").otherwise("accepted")
    return windows.withColumn("status", status).withColumn("samples", F.when(F.col("status") == "accepted", F.least(n, F.lit(max_ms * rate // 1000))))


KINDS = ("sentence", "gold")


def request_errors(requests: DataFrame, windows: DataFrame, now_ms: int, model: str, rate: int = 16_000) -> DataFrame:
    """Requests with the first of their errors: code (400 or 504) and detail, null for those that may run.

    requests: request_id, sample_rate, expected_model_version, deadline_ms; windows: request_id, window_id, offset, length
    (bytes), kind. An id must be given once in a request, offsets and lengths hold whole 16-bit samples.
    """
    odd = (F.col("offset") < 0) | (F.col("length") <= 0) | (F.col("offset") % 2 != 0) | (F.col("length") % 2 != 0) | ~F.col("kind").isin(*KINDS) | (F.length("window_id") == 0) | (F.length("window_id") > 200)
    ids = windows.groupBy("request_id", "window_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(odd, F.lit(True))).alias("odd"))
    per = ids.groupBy("request_id").agg(F.bool_or("odd").alias("odd"), F.max("n").alias("most"))
    rows = requests.join(per, "request_id", "left")
    invalid = F.col("most").isNull() | F.col("odd") | (F.length("request_id") == 0) | (F.length("request_id") > 200) | F.coalesce(F.col("deadline_ms") <= 0, F.lit(True))
    detail = (
        F.when(invalid, "invalid metadata").when(F.coalesce(F.col("sample_rate") != rate, F.lit(True)), f"sample_rate must be {rate}").when(F.coalesce(F.col("expected_model_version") != model, F.lit(True)), "model version mismatch")
        .when(F.col("deadline_ms") <= now_ms, "request deadline exceeded").when(F.col("most") > 1, "duplicate window_id")
    )
    code = F.when(detail == "request deadline exceeded", 504).when(detail.isNotNull(), 400)
    return rows.select(*requests.columns, code.alias("code"), detail.alias("detail"))


def answer_status(answers: DataFrame, now_ms: Column) -> DataFrame:
    """Adds status to requests with started_ms and finished_ms: a request whose deadline had passed when it would have begun was
    not inferred; one that finished late counts as late, whatever it found."""
    status = F.when(F.col("started_ms").isNull() & (now_ms >= F.col("deadline_ms")), "expired_before_inference").when(F.col("finished_ms") >= F.col("deadline_ms"), "deadline_exceeded").when(F.col("finished_ms").isNull(), "pending").otherwise("success")
    return answers.withColumn("status", status)


def refine_errors(answers: DataFrame) -> DataFrame:
    """Adds error and retryable to answers of the refinement (ready boolean, outcome: ok, timeout or unreachable, http int, body),
    at now_ms with deadline_ms."""
    v = F.try_parse_json("body")
    error = (
        F.when((F.col("outcome") == "timeout") & (F.col("now_ms") >= F.col("deadline_ms")), "DEADLINE_EXCEEDED").when(F.col("outcome") == "timeout", "WINDOW_REFINE_TIMEOUT")
        .when((F.col("outcome") != "ok") | ~F.col("ready"), "WINDOW_REFINE_UNAVAILABLE").when(F.col("http") == 401, "WINDOW_REFINE_AUTH").when((F.col("http") != 200) | v.isNull(), "WINDOW_REFINE_PROTOCOL")
        .when(~F.coalesce(F.try_variant_get(v, "$.success", "boolean"), F.lit(False)), "WINDOW_REFINE_INFERENCE")
        .when(~F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.speech_window_candidates", "variant")).startswith("ARRAY"), F.lit(False)), "WINDOW_REFINE_PROTOCOL")
    )
    return answers.withColumn("error", error).withColumn("retryable", F.when(error.isNotNull(), ~error.isin("WINDOW_REFINE_AUTH")))


def client_ordered(windows: DataFrame) -> DataFrame:
    """Adds place: by clipped duration, start, end and id, as requests are sent."""
    w = Window.partitionBy(KEY).orderBy(F.col("end_ms") - F.col("start_ms"), "start_ms", "end_ms", "request_id")
    return windows.withColumn("place", F.row_number().over(w))


def load_fixture(windows: DataFrame) -> DataFrame:
    """Windows of a load test, laid one after the other: window_id, offset, length (bytes), kind. windows: recording_id (one
    test each), place (their order, from 0), duration_ms."""
    rows = windows.select(KEY, "place", (F.col("duration_ms") * 32).cast("long").alias("length"))
    before = Window.partitionBy(KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(KEY, F.concat(F.lit("window:"), F.col("place").cast("string")).alias("window_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", F.when(F.col("place") % 2 == 1, "sentence").otherwise("gold").alias("kind"))


def load_report(calls: DataFrame, windows: int) -> DataFrame:
    """Per run of a load test: requests, windows a second, median and largest latency. calls: run, started_ms, finished_ms, ok."""
    elapsed = (F.max("finished_ms") - F.min("started_ms")) / 1000
    latency = F.when(F.col("ok"), (F.col("finished_ms") - F.col("started_ms")) / 1000)
    return calls.groupBy("run").agg(
        F.count_if("ok").alias("requests_succeeded"), F.round(elapsed, 2).alias("elapsed_seconds"), F.round(F.when(elapsed > 0, F.count_if("ok") * windows / elapsed).otherwise(0.0), 3).alias("windows_per_second"),
        F.round(F.median(latency), 3).alias("latency_p50_seconds"), F.round(F.max(latency), 3).alias("latency_max_seconds"),
    )


def embedded(results: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every request's vector through its canonical window, in request order: aliases (request, canonical), results (canonical,
    embedding, status). A window without a result is missing_result."""
    rows = aliases.join(results.select("canonical", "embedding", F.col("status").alias("found")), "canonical", "left")
    return rows.withColumn("status", F.coalesce("found", F.lit("missing_result"))).drop("found")


def within_deadline(requests: DataFrame, now_ms: Column) -> DataFrame:
    """Adds deadline_exceeded: at the deadline it is too late."""
    return requests.withColumn("deadline_exceeded", now_ms >= F.col("deadline_ms"))


def length_ordered(windows: DataFrame, *tie: str) -> DataFrame:
    """Adds place: shortest first, so that a batch is padded little; equal lengths keep their order."""
    return windows.withColumn("place", F.row_number().over(Window.partitionBy(KEY).orderBy("samples", *tie)))


def with_detected_overlap(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """Frames that meet a detected overlap have at least two active speakers. ranges: recording_id, start_ms, end_ms."""
    hit = overlap_join(frames.select(KEY, "start_ms", "end_ms"), ranges.select(KEY, "start_ms", "end_ms"), how="left_semi").distinct().withColumn("hit", F.lit(True))
    return frames.join(hit, [KEY, "start_ms", "end_ms"], "left").withColumn("active", F.when(F.col("hit"), F.greatest(F.lit(2), F.col("active"))).otherwise(F.col("active"))).drop("hit")


def prediction_frames(predictions: DataFrame, duration: Column) -> DataFrame:
    """Rows of a prediction (array `rows`): frame, start_ms, end_ms, row. They lie where the model says (arrays `starts` and `ends`
    in seconds, if there are such columns and they aren't null), else evenly over the duration."""
    step = F.greatest(F.lit(1.0), duration / F.size("rows"))
    if {"starts", "ends"} <= set(predictions.columns):
        rows = prediction_frames(predictions.withColumnsRenamed({"starts": "_starts", "ends": "_ends"}), duration)
        given = lambda c, own: F.when(F.col(c).isNotNull() & F.col("_ends").isNotNull(), F.bround(F.col(c)[F.col("frame")] * 1000).cast("long")).otherwise(F.col(own))
        return rows.withColumns({"start_ms": given("_starts", "start_ms"), "end_ms": given("_ends", "end_ms")}).drop("_starts", "_ends")
    return predictions.withColumn("step", step).select("*", F.posexplode("rows").alias("frame", "row")).withColumn("start_ms", F.bround(F.col("frame") * F.col("step")).cast("long")).withColumn("end_ms", F.bround((F.col("frame") + 1) * F.col("step")).cast("long")).drop("rows", "step")


def provenance(manifest: DataFrame) -> DataFrame:
    """Source and grade of each row: the manifest's, else the reference's, else (source) the id. Both given but unlike is an error.

    manifest: id, source, grade, reference_source, reference_grade.
    """
    unlike = lambda a, b: F.col(a).isNotNull() & (F.col(a) != "") & F.col(b).isNotNull() & (F.col(b) != "") & (F.col(a) != F.col(b))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    error = F.when(unlike("source", "reference_source") | unlike("grade", "reference_grade"), "EVALUATION_PROVENANCE_MISMATCH")
    return manifest.select("id", F.coalesce(blank("source"), blank("reference_source"), F.col("id").cast("string")).alias("source"), F.coalesce(blank("grade"), F.col("reference_grade")).alias("grade"), error.alias("error"))


def public_tasks(tasks: DataFrame) -> DataFrame:
    """The shown columns of tasks as JSON without nulls."""
    return tasks.select("task_id", F.to_json(F.struct(*[c for c in PUBLIC if c in tasks.columns]), {"ignoreNullFields": "true"}).alias("task"))


def recent(visits: DataFrame, most: int = 20) -> DataFrame:
    """Per user the last `most` different tasks, latest first. visits: user_id, task, at_ms."""
    last = visits.groupBy("user_id", "task").agg(F.max("at_ms").alias("at_ms"))
    w = Window.partitionBy("user_id").orderBy(F.col("at_ms").desc(), "task")
    return last.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def colours(segments: DataFrame, n: int = 6) -> DataFrame:
    """Per recording a colour for each speaker, by first appearance."""
    first = segments.groupBy(KEY, "speaker").agg(F.min(F.struct("start_ms", "input_index")).alias("first"))
    return first.withColumn("colour", F.pmod(F.row_number().over(Window.partitionBy(KEY).orderBy("first")) - 1, F.lit(n))).drop("first")


def candidate_ks(estimates: DataFrame, most: int = 6) -> DataFrame:
    """The numbers of clusters to try: one less, the estimate, one more, within 1 and the number of vectors. estimates: k, n."""
    top = F.least(F.lit(most), F.col("n"))
    clamp = lambda k: F.greatest(F.lit(1), F.least(top, k))
    return estimates.withColumn("ks", F.array_sort(F.array_distinct(F.array(*[clamp(F.col("k") + d) for d in (-1, 0, 1)]))))


def unverified(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Files of a list (path, size, sha256) that aren't found as listed."""
    return wanted.join(found, ["path", "size", "sha256"], "left_anti")


def scenario_tags(segments: DataFrame, overlap: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """Per recording its scenarios: how many speakers, overlaps, a role that holds one of the marks. overlap: recording_id, has_overlap."""
    per = segments.groupBy(KEY).agg(F.count_distinct("speaker").alias("n"), F.coalesce(F.bool_or(F.col("role").rlike("|".join(marks))), F.lit(False)).alias("marked"))
    tags = F.array_compact(F.array(F.when(F.col("n") == 1, "single_speaker").when(F.col("n") == 2, "two_speaker").when(F.col("n") > 2, "multi_speaker"), F.when(F.col("has_overlap"), "overlap"), F.when(F.col("marked"), "noisy_or_far_field")))
    return per.join(overlap, KEY).select(KEY, tags.alias("scenarios"))


def chunks(recordings: DataFrame, chunk_ms: int = 30_000) -> DataFrame:
    """Readings of at most chunk_ms of each recording. recordings: recording_id, duration_ms."""
    rows = recordings.filter("duration_ms > 0").withColumn("start_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, F.lit(chunk_ms).cast("long"))))
    return rows.withColumn("end_ms", F.least(F.col("duration_ms"), F.col("start_ms") + chunk_ms))
