"""Candidate regions, window scores, tiers and gold windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.intervals import KEY, by_time, with_islands
from voxframe.operators.timelines import WINDOWS, Windows
from voxframe.params import Candidates, Scoring


def candidates(segments: DataFrame, p: Candidates = Candidates(), by: Windows = WINDOWS) -> DataFrame:
    """Segments at most max_join_gap_ms apart as one region. The speaker column is not read.

    segments: recording_id, input_index, start_ms, end_ms, text, confidence. by: see with_islands.
    """
    rows = with_islands(segments.select(KEY, "input_index", "start_ms", "end_ms", "text", "confidence"), p.max_join_gap_ms, by=by)
    rows = by.running(rows, "within", F.col("end_ms"), "max", ("start_ms", "input_index"), (KEY, "island"), before=True)
    rows = rows.withColumn("gap", F.greatest(F.lit(0), F.col("start_ms") - F.col("within")))
    out = rows.groupBy(KEY, "island").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("segment_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "input_index"))), lambda x: x["input_index"]).alias("source_segment_indices"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("max_internal_gap_ms"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("text_chars"),
    )
    return out.withColumn("candidate_id", F.format_string("asr_candidate_%03d", F.col("island"))).drop("island")


def _between(x: Column, bands: tuple, low_closed: bool) -> Column:
    hit = lambda lo, hi: (x >= lo) & (x < hi) if low_closed else (x > lo) & (x <= hi)
    out = F.lit(0.0)
    for lo, hi, value in bands:
        out = F.when(hit(lo, hi), F.lit(value)).otherwise(out)
    return out


def scored(windows: DataFrame, p: Scoring = Scoring()) -> DataFrame:
    """Adds penalty, score, tier, accepted, reject_reasons. Missing measures count as 0, missing loudness rejects."""
    d, ratio = F.col("duration_ms"), F.coalesce("speech_ratio", F.lit(0.0))
    deviation, flags = F.coalesce("loudness_std_db", F.lit(0.0)), F.coalesce("flags", F.array().cast("array<string>"))
    rejects = F.array_compact(F.array(
        F.when(d < p.min_duration, "duration_too_short"), F.when(ratio < p.min_ratio, "speech_ratio_too_low"),
        F.when((F.coalesce("overlap_ms", F.lit(0)) > 0) | F.array_contains(flags, "residual_overlap"), "overlap_detected"),
        F.when((F.coalesce("change_point_count", F.lit(0)) > 0) | F.array_contains(flags, "residual_speaker_change"), "speaker_change_detected"),
        F.when(F.coalesce(F.col("loudness_db") < p.min_loudness, F.lit(True)), "loudness_too_low"),
    ))
    penalty = _between(d, p.short, True) + _between(ratio, p.ratio, True) + _between(deviation, p.deviation, False)
    for side in ("left", "right"):
        penalty = penalty + F.when(F.coalesce(f"boundary_{side}_silence_ms", F.lit(0)) < p.edge_silence, p.edge_penalty).otherwise(0.0)
    for flag, value in p.flag_penalties:
        penalty = penalty + F.when(F.array_contains(flags, flag), value).otherwise(0.0)
    rows = windows.withColumn("reject_reasons", rejects).withColumn("penalty", penalty).withColumn("score", F.round(F.greatest(F.lit(0.0), 100 - F.col("penalty")), 2))
    tier = F.when(F.size("reject_reasons") > 0, "rejected")
    for least, name in p.tiers:
        tier = tier.when(F.col("score") >= least, name)
    return rows.withColumn("tier", tier.otherwise("rejected")).withColumn("accepted", F.col("tier").isin(*[n for n, _ in p.gold_weights]))


def histogram(df: DataFrame, column: str, name: str) -> DataFrame:
    """How often each value occurs; an array counts by element."""
    value = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)
    return df.select(value.alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def gold(windows: DataFrame, p: Scoring = Scoring()) -> DataFrame:
    """Adds skip_reason (null for gold windows) and weight."""
    names = [n for n, _ in p.gold_weights]
    reason = F.when(~F.col("tier").isin(*names), "tier_not_gold").when(~F.coalesce("accepted", F.lit(True)), "not_accepted").when(F.col("end_ms") <= F.col("start_ms"), "invalid_range")
    weight = F.lit(None).cast("double")
    for name, w in p.gold_weights:
        weight = F.when(F.col("tier") == name, w).otherwise(weight)
    return windows.withColumn("skip_reason", reason).withColumn("weight", F.when(F.col("skip_reason").isNull(), weight))


def deduplicated(windows: DataFrame, p: Candidates = Candidates(), order: str = "request_order") -> DataFrame:
    """Adds clip_end (a window counts for at most max_clip_ms) and keeps the first request of each (start, clip_end)."""
    rows = windows.withColumn("clip_end", F.least(F.col("end_ms"), F.col("start_ms") + p.max_clip_ms))
    w = Window.partitionBy(KEY, "start_ms", "clip_end").orderBy(order)
    return rows.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def validated(segments: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Segments that break a rule, with the rule's name; several rules give several rows."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(KEY, "id"))
    rows = segments.withColumn("n_id", twice)
    if durations is not None:
        rows = rows.join(durations, KEY, "left")
    checks = [
        F.when(F.coalesce("id", F.lit("")) == "", "empty_id"), F.when(F.col("n_id") > 1, "duplicate_id"),
        F.when(F.coalesce(F.col("start_ms") < 0, F.lit(True)), "negative_start"), F.when(F.coalesce(F.col("end_ms") <= F.col("start_ms"), F.lit(True)), "invalid_range"),
        F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), "confidence_out_of_range"),
    ]
    if durations is not None:
        checks.append(F.when(F.col("end_ms") > F.col("duration_ms"), "beyond_audio"))
    return rows.select(KEY, "input_index", F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def ordinals(segments: DataFrame) -> DataFrame:
    """Segments in time order with a 1-based ordinal."""
    return segments.withColumn("ordinal", F.row_number().over(by_time()))
