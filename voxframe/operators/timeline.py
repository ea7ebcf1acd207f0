"""Activity frames to single-speaker windows.

Frames: recording_id, start_ms, end_ms, active (speakers at once), dom (the dominant speaker, '' if none), in order of
start_ms. `over` names the columns that make one timeline; a candidate's frames are a timeline of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.vectors import rms_db
from voxframe.operators.intervals import KEY, overlap_join, overlap_ms, union
from voxframe.operators.timelines import WINDOWS, Windows
from voxframe.params import Timeline
from voxframe.shared import steady


ORDER = ("start_ms", "end_ms", "dom")


def _order(over: tuple, *more: str) -> Window:
    return Window.partitionBy(*over, *more).orderBy(*ORDER)


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _upto(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def speaker_changes(frames: DataFrame, over: tuple = (KEY,)) -> DataFrame:
    """Adds `change`: a lone speaker unlike the lone speaker before, whatever lies between."""
    last = F.last(F.when((F.col("active") == 1) & (F.col("dom") != ""), F.col("dom")), ignorenulls=True).over(_before(_order(over)))
    change = (F.col("active") == 1) & (F.col("dom") != "") & last.isNotNull() & (last != F.col("dom"))
    return frames.withColumn("change", F.coalesce(change, F.lit(False)))


def blocked(frames: DataFrame, p: Timeline = Timeline(), over: tuple = (KEY,), by: Windows = WINDOWS) -> DataFrame:
    """Ranges that no window may touch: around overlaps, and around speaker changes over at most join_gap_ms of silence. by: see
    intervals.with_islands."""
    around = frames.filter("active >= 2").select(*over, (F.col("start_ms") - p.edge_trim_ms).alias("start_ms"), (F.col("end_ms") + p.edge_trim_ms).alias("end_ms"))
    part = (*over, "stretch")
    rows = by.running(by.deal(frames, ORDER, over), "stretch", (F.col("active") >= 2).cast("int"), "sum", ORDER, over)
    silence = F.when(F.col("active") == 0, F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).otherwise(0)
    rows = by.running(rows, "silence", silence, "sum", ORDER, part).filter("active = 1")
    rows = by.running(rows, "old", F.struct("dom", "end_ms", "silence"), "last", ORDER, part, before=True)
    change = rows.filter((F.col("old.dom") != "") & (F.col("dom") != "") & (F.col("old.dom") != F.col("dom")) & (F.col("silence") - F.col("old.silence") <= p.join_gap_ms))
    at = F.greatest("old.end_ms", "start_ms")
    steady(frames.sparkSession)
    return union(around.unionByName(change.select(*over, (at - p.edge_trim_ms).alias("start_ms"), (at + p.edge_trim_ms).alias("end_ms"))), over, by).drop("island")


def single_speaker_runs(frames: DataFrame, p: Timeline = Timeline(), over: tuple = (KEY,), by: Windows = WINDOWS) -> DataFrame:
    """Runs of lone speech, parted by blocked ranges, overlaps and gaps of over join_gap_ms. by: see intervals.with_islands."""
    # Blocked ranges are disjoint and sorted, so the last that starts before a frame's end is the only one that can meet it.
    ranges = blocked(frames, p, over, by)
    marks = ranges.select(*over, F.col("start_ms").alias("at"), F.lit(0).alias("is_frame"), F.col("end_ms").alias("range_end"), *[F.lit(None).cast(t).alias(c) for c, t in (("start_ms", "long"), ("end_ms", "long"), ("active", "int"), ("dom", "string"))])
    rows = frames.select(*over, F.col("end_ms").alias("at"), F.lit(1).alias("is_frame"), F.lit(None).cast("long").alias("range_end"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.col("active").cast("int").alias("active"), "dom")
    rows = rows.unionByName(marks).withColumn("frame_first", -F.col("is_frame"))
    ends = ("at", "frame_first", "start_ms")
    rows = by.running(by.deal(rows, ends, over), "reach", F.col("range_end"), "last", ends, over).filter("is_frame = 1")
    closer = (F.coalesce(F.col("reach") > F.col("start_ms"), F.lit(False)) | (F.col("active") >= 2)).cast("int")
    rows = by.running(by.deal(rows.withColumn("closer", closer), ORDER, over), "stretch", F.col("closer"), "sum", ORDER, over).filter("closer = 0")
    part = (*over, "stretch")
    rows = by.running(rows, "silent_to", F.when(F.col("active") == 0, F.col("end_ms")), "max", ORDER, part, before=True).filter("active = 1")
    rows = by.running(rows, "last_end", F.col("end_ms"), "last", ORDER, part, before=True)
    last = F.col("last_end")
    rows = rows.withColumn("new", (last.isNull() | (F.greatest("start_ms", F.coalesce("silent_to", F.lit(0))) - last > p.join_gap_ms)).cast("int"))
    rows = by.running(rows, "run", F.col("new"), "sum", ORDER, part)
    runs = rows.groupBy(*over, "stretch", "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return runs.filter("end_ms > start_ms").select(*over, "start_ms", "end_ms")


def boundary_silence(frames: DataFrame, over: tuple = (KEY,)) -> DataFrame:
    """Adds, per frame, the silence that ends where it starts and the silence that starts where it ends. Both are running
    values, one in the order of the frames and one against it."""
    length = F.when(F.col("active") == 0, F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).otherwise(0)
    voiced = F.col("active") != 0
    there = _order(over)
    back = Window.partitionBy(*over).orderBy(F.col("start_ms").desc(), F.col("end_ms").desc(), F.col("dom").desc())
    rows = frames
    for side, w in (("left", there), ("right", back)):
        through = F.sum(length).over(_upto(w))
        rows = rows.withColumn("_through", through)
        last = F.last(F.when(voiced, F.col("_through")), ignorenulls=True).over(_before(w))
        rows = rows.withColumn(f"{side}_silence_ms", (F.col("_through") - length - F.coalesce(last, F.lit(0))).cast("long"))
    return rows.drop("_through")


def loudness(frames: DataFrame, over: tuple = (KEY,), db: Column | None = None, p: Timeline = Timeline()) -> DataFrame:
    """speech_ratio, loudness_db, loudness_std_db of frames louder than silence; the last two over speech, if there is any."""
    db = rms_db(F.col("power")) if db is None else db
    rows = frames.select(*over, db.alias("db")).withColumn("kept", F.col("db") > p.silence_db).withColumn("speech", F.col("db") >= p.speech_db)
    kept, speech = F.when(F.col("kept"), F.col("db")), F.when(F.col("kept") & F.col("speech"), F.col("db"))
    out = rows.groupBy(*over).agg(F.count(kept).alias("n_kept"), F.count(speech).alias("n_speech"), F.avg(kept).alias("a"), F.avg(speech).alias("b"), F.stddev_pop(kept).alias("c"), F.stddev_pop(speech).alias("d"))
    return out.select(*over, "n_kept", "n_speech", F.round(F.col("n_speech") / F.greatest(F.lit(1), F.col("n_kept")), 4).alias("speech_ratio"), F.round(F.coalesce("b", "a"), 2).alias("loudness_db"), F.round(F.coalesce("d", "c", F.lit(0.0)), 4).alias("loudness_std_db"))


def powerset(p: Column) -> tuple[Column, Column, Column]:
    """(active speakers, dominant speaker, confidence) of class shares: 7 classes are silence, three lone speakers and
    three pairs; 2 are silence and speech; 1 is a speech share; others are silence and lone speakers."""
    best = F.array_max(p)
    k = F.array_position(p, best).cast("int") - 1
    n = F.size(p)
    one = n == 1
    active = F.when(one, (p[0] >= 0.5).cast("int")).when(n == 7, F.element_at(F.array(*[F.lit(x) for x in (0, 1, 1, 1, 2, 2, 2)]), k + 1)).otherwise((k > 0).cast("int"))
    first = F.element_at(F.array(*[F.lit(x) for x in ("", "speaker_0", "speaker_1", "speaker_2", "speaker_0", "speaker_0", "speaker_1")]), F.least(k, F.lit(6)) + 1)
    dom = F.when(one, F.when(p[0] >= 0.5, "speaker_0").otherwise("")).when(n == 7, first).otherwise(F.when(k > 0, F.concat(F.lit("speaker_"), (k - 1).cast("string"))).otherwise(""))
    return active, dom, F.when(one, F.greatest(p[0], 1 - p[0])).otherwise(best)


def own_frames(candidates: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames that meet each candidate, with its id: a timeline of its own."""
    c = candidates.select(KEY, "start_ms", "end_ms", "candidate_id")
    pairs = overlap_join(frames, c)
    return pairs.drop("right_start_ms", "right_end_ms")


#: How far a boundary's silence and the frames at it are looked for; a candidate is one stretch of speech.
OVER = (KEY, "candidate_id")


def built(candidates: DataFrame, frames: DataFrame, power: DataFrame | None = None, p: Timeline = Timeline(), keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> DataFrame:
    """Windows of each candidate: its single-speaker runs clamped to it, with overlap, changes, boundary silence, loudness and
    flags, and a window_id over all candidates of a recording in order.

    candidates: recording_id, candidate_id, start_ms, end_ms. power: 30 ms frames (recording_id, start_ms, end_ms, power)
    of the audio; without it the loudness is unknown: ratio 0, no decibels, deviation 0. keep(rows, name) may write what is read
    several times and give what it wrote.
    """
    steady(frames.sparkSession)
    own = keep(own_frames(candidates, frames), "own_frames")
    c = candidates.select(*OVER, F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end"))
    runs = single_speaker_runs(own, p, OVER).join(c, list(OVER))
    runs = runs.select(*OVER, F.col("start_ms").alias("raw_start_ms"), F.col("end_ms").alias("raw_end_ms"), F.greatest("start_ms", "c_start").alias("start_ms"), F.least("end_ms", "c_end").alias("end_ms"))
    runs = keep(runs, "runs")
    # Frames by window: those that it meets, for overlap and changes; a window's key is its candidate and raw start.
    keyed = runs.select(F.concat_ws("|", F.col(KEY).cast("string"), "candidate_id").alias("line"), "raw_start_ms", "start_ms", "end_ms")
    mine = own.select(F.concat_ws("|", F.col(KEY).cast("string"), "candidate_id").alias("line"), "start_ms", "end_ms", "active", "dom")
    met = overlap_join(mine, keyed, key="line").withColumnRenamed("line", KEY)
    marked = speaker_changes(met, (KEY, "raw_start_ms"))
    overlapped = F.when(F.col("active") >= 2, overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("right_start_ms"), F.col("right_end_ms"))).otherwise(0)
    stats = marked.groupBy(F.col(KEY).alias("line"), "raw_start_ms").agg(F.sum(overlapped).alias("overlap_ms"), F.sum(F.col("change").cast("int")).alias("change_point_count"))
    rows = runs.withColumn("line", F.concat_ws("|", F.col(KEY).cast("string"), "candidate_id")).join(stats, ["line", "raw_start_ms"], "left")
    rows = rows.join(_edges(own, runs), [*OVER, "raw_start_ms"], "left").drop("line")
    loud = ("speech_ratio", "loudness_db", "loudness_std_db")
    if power is None:
        rows = rows.withColumns({"speech_ratio": F.lit(0.0), "loudness_db": F.lit(None).cast("double"), "loudness_std_db": F.lit(0.0)})
    else:
        heard = overlap_join(power.select(KEY, "start_ms", "end_ms", "power"), runs.select(KEY, "candidate_id", "raw_start_ms", "start_ms", "end_ms"))
        heard = heard.filter("start_ms >= right_start_ms and end_ms <= right_end_ms")
        rows = rows.join(loudness(heard, (*OVER, "raw_start_ms"), p=p).select(*OVER, "raw_start_ms", *loud), [*OVER, "raw_start_ms"], "left")
        rows = rows.withColumn("speech_ratio", F.coalesce("speech_ratio", F.lit(0.0))).withColumn("loudness_std_db", F.coalesce("loudness_std_db", F.lit(0.0)))
    rows = rows.withColumn("overlap_ms", F.coalesce("overlap_ms", F.lit(0)).cast("long")).withColumn("change_point_count", F.coalesce("change_point_count", F.lit(0)).cast("int"))
    flags = F.array_compact(F.array(
        F.when(F.col("end_ms") - F.col("start_ms") < p.tiny_ms, "tiny_interval"), F.when(F.col("speech_ratio") < p.low_ratio, "low_speech_ratio"), F.when(F.col("overlap_ms") > 0, "residual_overlap"),
        F.when(F.col("change_point_count") > 0, "residual_speaker_change"), F.when(F.col("loudness_std_db") > p.unstable_db, "unstable_loudness"),
    ))
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("candidate_id", "raw_start_ms")) - 1
    return rows.select(
        *OVER, F.format_string("speech_window_%03d", number).alias("window_id"), "start_ms", "end_ms", F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "raw_start_ms", "raw_end_ms",
        "overlap_ms", "change_point_count", F.coalesce("left", F.lit(0)).cast("long").alias("boundary_left_silence_ms"), F.coalesce("right", F.lit(0)).cast("long").alias("boundary_right_silence_ms"), *loud, flags.alias("flags"),
    )


def _edges(own: DataFrame, runs: DataFrame) -> DataFrame:
    """Per window the silence of the frames that end at or before its start, from there back, and of those that start at or
    after its end, from there on. Boundaries are rows among the frames, so a running value carries the silence to them."""
    blank = F.lit(None).cast("long")
    out = None
    for side, at in (("left", "start_ms"), ("right", "end_ms")):
        left = side == "left"
        f = own.select(*OVER, F.col("end_ms" if left else "start_ms").cast("long").alias("at"), F.lit(0 if left else 1).alias("mark"), "active", (F.col("end_ms") - F.col("start_ms")).cast("long").alias("ms"), blank.alias("raw_start_ms"))
        b = runs.select(*OVER, F.col(at).cast("long").alias("at"), F.lit(1 if left else 0).alias("mark"), F.lit(-1).alias("active"), F.lit(0).cast("long").alias("ms"), F.col("raw_start_ms").cast("long").alias("raw_start_ms"))
        order = (F.col("at"), F.col("mark")) if left else (F.col("at").desc(), F.col("mark").desc())
        w = Window.partitionBy(*OVER).orderBy(*order)
        rows = f.unionByName(b).withColumn("through", F.sum(F.when(F.col("active") == 0, F.greatest(F.lit(0).cast("long"), F.col("ms"))).otherwise(0)).over(_upto(w)))
        last = F.last(F.when(F.col("active") > 0, F.col("through")), ignorenulls=True).over(_upto(w))
        rows = rows.withColumn(side, F.col("through") - F.coalesce(last, F.lit(0))).filter("active = -1").select(*OVER, "raw_start_ms", side)
        out = rows if out is None else out.join(rows, [*OVER, "raw_start_ms"])
    return out


def split_events(candidates: DataFrame, frames: DataFrame, p: Timeline = Timeline()) -> DataFrame:
    """What the splitting met, by candidate: blocked_interval with its range, or no_segmentation_frames."""
    own = own_frames(candidates, frames)
    ranges = blocked(own, p, OVER).select(*OVER, F.lit("blocked_interval").alias("reason"), "start_ms", "end_ms")
    none = candidates.select(*OVER).join(own.select(*OVER).distinct(), list(OVER), "left_anti")
    blank = F.lit(None).cast("long")
    return ranges.unionByName(none.select(*OVER, F.lit("no_segmentation_frames").alias("reason"), blank.alias("start_ms"), blank.alias("end_ms")))


def event_counts(events: DataFrame) -> DataFrame:
    """How often each reason occurred in a recording."""
    return events.groupBy(KEY, "reason").agg(F.count(F.lit(1)).alias("n"))


def first_events(events: DataFrame, most: int = 120) -> DataFrame:
    """The first events of a recording, in order of candidates and time; later ones are only counted."""
    w = Window.partitionBy(KEY).orderBy("candidate_id", F.col("start_ms").asc_nulls_first())
    return events.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def candidate_results(candidates: DataFrame, windows: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Per candidate its status and number of windows: success, empty, or inference_failed with the error of `failures`
    (recording_id, candidate_id, error). A candidate that fails spoils no other."""
    n = windows.groupBy(*OVER).agg(F.count(F.lit(1)).alias("window_count"))
    rows = candidates.select(*OVER).join(n, list(OVER), "left")
    rows = rows.join(failures.select(*OVER, "error"), list(OVER), "left") if failures is not None else rows.withColumn("error", F.lit(None).cast("string"))
    failed = F.col("error").isNotNull()
    count = F.when(failed, F.lit(0)).otherwise(F.coalesce("window_count", F.lit(0))).cast("long")
    return rows.select(*OVER, F.when(failed, "inference_failed").when(F.col("window_count") > 0, "success").otherwise("empty").alias("status"), count.alias("window_count"), "error")
