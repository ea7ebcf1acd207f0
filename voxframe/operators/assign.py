"""Segments to speakers: nearest anchors, strict levels, quality bands, recall, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.vectors import unit, unit_cosine
from voxframe.operators.intervals import KEY
from voxframe.params import Assignment, Clusters


#: The version that records carry, the flags of a reason for which a segment stays unknown, the evidence.
POLICY = "segment_assignment_v2"
UNKNOWN_FLAGS = {
    "missing_segment_embedding": "no_embedding", "no_gold_window_speakers": "no_anchor_speaker", "outside_accept_radius": "outside_accept_radius",
    "margin_too_low": "low_relative_margin", "inside_radius_but_margin_too_low": "low_relative_margin",
}
EVIDENCE = (
    "candidate_speaker", "best_distance", "second_distance", "margin", "relative_margin", "center_distance", "medoid_distance", "speaker_core_radius", "speaker_boundary_radius",
    "speaker_accept_radius", "speaker_margin", "speaker_purity_score", "speaker_concentration", "speaker_is_reliable", "duration_ms", "quality_band", "strict_assignment_level", "strict_reason",
)
NONE = "cast(array() as array<string>)"


def with_quality(segments: DataFrame, qualities: DataFrame) -> DataFrame:
    """Segments with the measures of their audio, null where there are none. Both: recording_id, input_index."""
    return segments.join(qualities.select(KEY, "input_index", "speech_ratio", "loudness_db", "loudness_std_db"), [KEY, "input_index"], "left")


def top_two(sentences: DataFrame, anchors: DataFrame, p: Clusters = Clusters()) -> DataFrame:
    """Per sentence (recording_id, vec_id, embedding, ...) the next anchor, its distance d1, the second's d2 (1 with one
    anchor), margin and relative margin. A recording has few anchors; rows without a vector or anchor have nulls, and
    has_vector and has_anchors say which."""
    s = sentences.withColumn("u", unit(F.col("embedding").cast("array<double>")))
    a = anchors.select(KEY, "label", "first_id", "centre", "medoid", "core_radius", "boundary_radius", "accept_radius", F.col("margin").alias("anchor_margin"), "purity_score", "concentration")
    center, medoid = 1 - unit_cosine(F.col("u"), F.col("centre")), 1 - unit_cosine(F.col("u"), F.col("medoid"))
    near = s.filter("u is not null").select(KEY, "vec_id", "u").join(a, KEY).withColumn("center_distance", center).withColumn("medoid_distance", medoid).drop("u", "centre", "medoid")
    near = near.withColumn("d", F.least(F.col("center_distance"), F.col("medoid_distance") + p.medoid_slack))
    w = Window.partitionBy(KEY, "vec_id").orderBy(F.round("d", 12), "first_id")
    ranked = near.withColumn("place", F.row_number().over(w)).withColumn("d2", F.coalesce(F.lead("d").over(w), F.lit(1.0))).filter("place = 1")
    margin = F.greatest(F.lit(0.0), F.col("d2") - F.col("d"))
    best = ranked.select(KEY, "vec_id", "label", F.col("d").alias("d1"), "d2", margin.alias("margin"), (margin / F.greatest(F.col("d"), F.lit(0.001))).alias("relative"), "center_distance", "medoid_distance", "core_radius", "boundary_radius", "accept_radius", "anchor_margin", "purity_score", "concentration")
    known = anchors.select(KEY).distinct().withColumn("has_anchors", F.lit(True))
    rows = s.withColumn("has_vector", F.col("u").isNotNull()).drop("u", "label", "embedding").join(best, [KEY, "vec_id"], "left").join(known, KEY, "left")
    return rows.withColumn("has_anchors", F.coalesce("has_anchors", F.lit(False)))


def strict(rows: DataFrame, p: Assignment = Assignment()) -> DataFrame:
    """Adds strict_level, strict_reason, strict_confidence. Distances are not rounded here, radii are. A row without a vector,
    or of a recording without anchors, is level unknown and has that as its reason."""
    d, r = F.col("d1"), F.col("relative")
    core = F.col("core_radius")
    boundary = F.greatest("core_radius", "boundary_radius")
    accept = F.greatest("core_radius", "boundary_radius", "accept_radius")
    missing = F.when(~F.col("has_vector"), "missing_segment_embedding").when(~F.col("has_anchors"), "no_gold_window_speakers")
    level = F.when(missing.isNotNull(), "unknown").when((d <= core + p.slack) & (r >= p.strong), "strong").when((d <= boundary + p.slack) & (r >= p.normal), "normal").when((d <= accept + p.slack) & (r >= p.tentative), "tentative").otherwise("unknown")
    reason = F.when(missing.isNotNull(), missing).when(F.col("strict_level") == "strong", "segment_embedding_strong").when(F.col("strict_level") == "normal", "segment_embedding_normal").when(F.col("strict_level") == "tentative", "inside_accept_radius_tentative").when(r < p.tentative, "margin_too_low").otherwise("outside_accept_radius")
    strong = F.least(F.lit(1.0), 0.85 + F.least(F.lit(0.15), 0.08 * r))
    normal = F.least(F.lit(0.85), 0.65 + F.least(F.lit(0.20), 0.10 * r))
    confidence = F.round(F.when(F.col("strict_level") == "strong", strong).when(F.col("strict_level") == "normal", normal).otherwise(0.0), 4)
    return rows.withColumn("strict_level", level).withColumn("strict_reason", reason).withColumn("strict_confidence", confidence)


def band(duration: Column, ratio: Column, deviation: Column, loudness: Column, p: Assignment = Assignment()) -> tuple[Column, Column]:
    """(band, reason); missing measures pass."""
    poor = F.when(duration < p.poor_ms, "duration_too_short_for_recall").when(ratio < p.poor_ratio, "speech_ratio_too_low_for_recall").when(deviation > p.poor_deviation, "loudness_too_unstable_for_recall").when(loudness < p.poor_loudness, "loudness_too_low_for_recall")
    good = (duration >= p.good_ms) & F.coalesce(ratio >= p.good_ratio, F.lit(True)) & F.coalesce(deviation <= p.good_deviation, F.lit(True))
    name = F.when(poor.isNotNull(), "poor").when(good, "good").otherwise("medium")
    return name, F.coalesce(poor, F.when(good, "quality_good").otherwise("quality_medium"))


def recalled(rows: DataFrame, p: Assignment = Assignment()) -> DataFrame:
    """The assignment of strict() rows, which need duration_ms, speech_ratio, loudness_std_db, loudness_db and the anchor's
    anchor_margin, purity_score, concentration: assigned_label, source, level, reason, confidence, risk_level, risk_score,
    flags. Rows that stay unknown keep the strict reason and its flags; why the recall left them is reject_reason, with
    reject_flags.

    Distances and margins are rounded to 6 first, and a rounded distance of 0 counts as 1.
    """
    quality, why = band(F.col("duration_ms"), F.col("speech_ratio"), F.col("loudness_std_db"), F.col("loudness_db"), p)
    d = F.when(F.round("d1", 6) == 0, 1.0).otherwise(F.round("d1", 6))
    rows = rows.withColumn("band", quality).withColumn("band_reason", why).withColumn("rd", d).withColumn("rr", F.round("relative", 6)).withColumn("rm", F.round("margin", 6))
    d, r, m = F.col("rd"), F.col("rr"), F.col("rm")
    radius = F.greatest("core_radius", "boundary_radius", "accept_radius")
    soft, wide = (r >= p.high_relative) | (m >= p.high_margin), (r >= p.low_relative) | (m >= p.low_margin)
    near, slack = d <= p.near + p.slack, d <= radius + p.over_radius + p.slack
    kept = F.col("strict_level").isin("strong", "normal")
    outside = (F.col("strict_reason") == "outside_accept_radius") | (d > radius + p.slack)
    flags = lambda *names: F.array(*[F.lit(n) for n in names]) if names else F.expr(NONE)
    result = lambda risk, reason, *names: F.struct(F.lit(risk).alias("risk"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), flags(*names).alias("flags"))
    decision = (
        F.when(kept, result("low", F.col("strict_reason")))
        .when(F.col("d1").isNull(), result("unassigned", "no_candidate_speaker"))
        .when(F.col("band") == "poor", result("unassigned", F.col("band_reason")))
        .when(d > p.hard_cap, result("unassigned", "distance_over_hard_cap"))
        .when((F.col("strict_level") == "tentative") & (d <= radius + p.slack), result("medium", "segment_embedding_tentative_recall", "tentative_margin"))
        .when(outside & near & slack & wide, result("high", "segment_embedding_outside_radius_recall", "outside_accept_radius", "relaxed_margin_recall"))
        .when(outside, result("unassigned", "outside_accept_radius_too_far", "outside_accept_radius"))
        .when(near & soft, result("medium", "segment_embedding_relaxed_margin_recall", "relaxed_margin_recall"))
        .when(near & wide, result("high", "segment_embedding_high_risk_margin_recall", "relaxed_margin_recall"))
        .otherwise(result("unassigned", "no_clear_top1_preference", "low_relative_margin", "small_absolute_margin"))
    )
    rows = rows.withColumn("decision", decision).withColumn("risk_level", F.col("decision.risk"))
    back, left = F.col("risk_level").isin("medium", "high"), F.col("risk_level") == "unassigned"
    more = F.array_compact(F.array(
        F.when(d > p.far, "high_distance_recall"), F.when(r < p.high_relative, "low_relative_margin"), F.when(m < p.high_margin, "small_absolute_margin"),
        F.when(F.col("band") == "medium", "medium_quality_recall"), F.when(F.col("speech_ratio") < p.good_ratio, "low_density_recall"),
        F.when(F.col("loudness_std_db") > p.good_deviation, "unstable_loudness_recall"), F.when(F.col("loudness_db") < p.quiet, "low_loudness_recall"),
        F.when(F.coalesce(F.col("anchor_margin") < p.weak_margin, F.lit(False)) | F.coalesce(F.col("purity_score") < p.weak_purity, F.lit(False)) | F.coalesce(F.col("concentration") < p.weak_concentration, F.lit(False)), "weak_speaker_anchor"),
    ))
    unknown = F.coalesce(F.expr(f"element_at(map({', '.join(f'{chr(39)}{k}{chr(39)}, array({chr(39)}{v}{chr(39)})' for k, v in UNKNOWN_FLAGS.items())}), strict_reason)"), F.expr(NONE))
    rows = rows.withColumn("flags", F.when(back, F.array_distinct(F.concat("decision.flags", more))).when(left, unknown).otherwise(F.expr(NONE)))
    rows = rows.withColumn("reject_reason", F.when(left, F.col("decision.reason"))).withColumn("reject_flags", F.when(left, F.col("decision.flags")))
    rows = rows.withColumn("reason", F.when(left, F.col("strict_reason")).otherwise(F.col("decision.reason")))
    n = F.size("flags")
    over = 0.01 * F.greatest(F.lit(0), n - 2)
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    high = clamp(0.48 + F.least(F.lit(0.06), 0.1 * r) + F.least(F.lit(0.03), 0.25 * m) - over, 0.42, 0.58)
    medium = clamp(0.58 + F.least(F.lit(0.07), 0.12 * r) + F.least(F.lit(0.04), 0.25 * m) - over, 0.52, 0.70)
    confidence = F.when(kept, F.col("strict_confidence")).when(F.col("risk_level") == "high", high).when(F.col("risk_level") == "medium", medium).otherwise(0.0)
    risk = F.when(F.col("strict_level") == "strong", 0.05).when(kept, 0.16).when(F.col("risk_level") == "high", F.least(F.lit(0.85), 0.61 + 0.03 * n)).when(F.col("risk_level") == "medium", F.least(F.lit(0.60), 0.36 + 0.03 * n)).otherwise(1.0)
    level = F.when(kept, F.col("strict_level")).when(back, "recalled").otherwise("unknown")
    rows = rows.withColumn("level", level).withColumn("confidence", F.round(confidence, 4)).withColumn("risk_score", F.round(risk, 4))
    source = F.when(kept, "first_pass").when(back, "recall").otherwise("unknown")
    return rows.withColumn("source", source).withColumn("assigned_label", F.when(left, "unknown").otherwise(F.col("label").cast("string"))).drop("decision", "band_reason", "rd", "rr", "rm")


def records(rows: DataFrame) -> DataFrame:
    """recalled() rows as records: recording_id, vec_id, assignment (label, status, source, level, confidence, reason, risk,
    evidence, policy_version). Evidence that a row doesn't have is null, so JSON without nulls leaves it out."""
    found, six = F.col("d1").isNotNull(), lambda c: F.round(c, 6)
    of = {
        "candidate_speaker": F.col("label").cast("string"), "best_distance": six("d1"), "second_distance": six("d2"), "margin": six("margin"), "relative_margin": six("relative"),
        "center_distance": six("center_distance"), "medoid_distance": six("medoid_distance"), "speaker_core_radius": six("core_radius"),
        "speaker_boundary_radius": six(F.greatest("core_radius", "boundary_radius")), "speaker_accept_radius": six(F.greatest("core_radius", "boundary_radius", "accept_radius")),
        "speaker_margin": F.col("anchor_margin"), "speaker_purity_score": F.col("purity_score"), "speaker_concentration": F.col("concentration"), "speaker_is_reliable": F.when(found, True),
        "duration_ms": F.col("duration_ms"), "quality_band": F.when(F.col("source") == "recall", F.col("band")),
        "strict_assignment_level": F.when(found, F.col("strict_level")), "strict_reason": F.when(found, F.col("strict_reason")),
    }
    quality = F.struct("speech_ratio", "loudness_db", "loudness_std_db").alias("quality")
    assignment = F.struct(
        F.col("assigned_label").alias("label"), F.when(F.col("source") == "unknown", "unknown").otherwise("assigned").alias("status"), "source", "level", "confidence", "reason",
        F.struct(F.col("risk_score").alias("score"), F.col("risk_level").alias("level"), "flags").alias("risk"),
        F.struct(*[of[name].alias(name) for name in EVIDENCE], quality).alias("evidence"), F.lit(POLICY).alias("policy_version"),
    )
    return rows.select(KEY, "vec_id", assignment.alias("assignment"))


def audit(rows: DataFrame) -> DataFrame:
    """Per recording, of recalled() rows: how many segments were assigned, recalled and left, and the recall's rejections."""
    rejected = F.map_from_entries(F.array_sort(F.collect_list(F.struct("reject_reason", "n")))).alias("rejected")
    sums = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("segment_count"), F.count_if(F.col("source") != "unknown").alias("assigned_count"), F.count_if(F.col("source") == "unknown").alias("unknown_count"),
        F.count_if(F.col("source") != "first_pass").alias("input_unknown_count"), F.count_if(F.col("source") == "recall").alias("recalled_count"),
    )
    reasons = rows.filter("reject_reason is not null").groupBy(KEY, "reject_reason").agg(F.count(F.lit(1)).alias("n")).groupBy(KEY).agg(rejected)
    return sums.join(reasons, KEY, "left")


def thresholds(p: Assignment = Assignment()) -> dict[str, float]:
    """The recall's limits, as an audit states them."""
    return {
        "medium_min_duration_ms": p.poor_ms, "medium_min_speech_ratio": p.poor_ratio, "medium_max_loudness_std_db": p.poor_deviation, "min_loudness_db": p.poor_loudness,
        "good_min_duration_ms": p.good_ms, "good_min_speech_ratio": p.good_ratio, "good_max_loudness_std_db": p.good_deviation, "soft_relative_margin": p.high_relative, "soft_margin": p.high_margin,
        "high_risk_relative_margin": p.low_relative, "high_risk_margin": p.low_margin, "accept_radius_slack": p.over_radius, "soft_max_distance": p.near, "hard_max_distance": p.hard_cap, "risk_distance": p.far,
    }


def threshold_counts(rows: DataFrame, p: Assignment = Assignment()) -> DataFrame:
    """The recall's limits as an audit states them, with how many rows keep to them: name, value, n (null for limits of what rows
    don't have). rows: duration_ms, speech_ratio, loudness_std_db, loudness_db."""
    of = {"duration_ms": "min_duration_ms", "speech_ratio": "min_speech_ratio", "loudness_std_db": "max_loudness_std_db", "loudness_db": "min_loudness_db"}
    found = []
    for name, value in thresholds(p).items():
        column = next((c for c, end in of.items() if name.endswith(end)), None)
        keeps = F.lit(None).cast("long") if column is None else F.count_if(F.col(column) <= value if "_max_" in name else F.col(column) >= value)
        found.append(F.struct(F.lit(name).alias("name"), F.lit(float(value)).alias("value"), keeps.alias("n")))
    return rows.agg(F.array(*found).alias("t")).select(F.inline("t"))


def levels(rows: DataFrame) -> DataFrame:
    """How many segments got each level."""
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") != "unknown").alias("assigned"))
