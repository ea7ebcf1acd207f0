"""Registered queries and the SQL that checks them.

Each query applies an operator to a view of the tables (see views.py); SQL is for DuckDB. Queries without SQL are
iterative or learned and are held against brute force in tests.
"""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions import text as tx
from voxframe.functions import vectors as vx
from voxframe.operators import assign, clusters, evaluate, intervals, kmeans, models, packing, requests, timeline, windows
from voxframe.operators.intervals import KEY
from voxframe.params import Candidates, Tasks, Timeline
from voxframe.plans import analysis
from voxframe.plans import task_queries, timeline_queries
from voxframe.plans import views as v
from voxframe.plans.registry import oracle_sql, queries, query
from voxframe.shared import scratch, spread
from voxframe.sources import audio, documents, exports, task_store
from voxframe.streaming import sessions

NOW = 820_000_000_000


# --- candidate regions -------------------------------------------------------------------------------------------

ISLANDS = """, reach as (select *, max(end_ms) over (partition by recording_id order by start_ms, input_index rows between unbounded preceding and 1 preceding) as m from v_seg),
isl as (select *, sum(case when start_ms - m > 500 then 1 else 0 end) over (partition by recording_id order by start_ms, input_index rows unbounded preceding) as island from reach),
gaps as (select *, greatest(0, start_ms - max(end_ms) over (partition by recording_id, island order by start_ms, input_index rows between unbounded preceding and 1 preceding)) as gap from isl),
cand as (select recording_id, island, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as segment_count, list(input_index order by start_ms, input_index) as source_segment_indices,
  coalesce(max(gap), 0) as max_internal_gap_ms, cast(sum(length(text)) as bigint) as text_chars from gaps group by recording_id, island)"""


@query(v.oracle("v_seg") + ISLANDS + " select recording_id, printf('asr_candidate_%03d', cast(island as int)) as candidate_id, start_ms, end_ms, segment_count, array_to_string(source_segment_indices, ',') as indices, cast(max_internal_gap_ms as bigint) as max_internal_gap_ms, text_chars from cand")
def candidate_discovery(spark: SparkSession, sf: str) -> DataFrame:
    c = windows.candidates(v.segments(spark, sf))
    return c.select(KEY, "candidate_id", "start_ms", "end_ms", "segment_count", F.array_join(F.transform("source_segment_indices", lambda x: x.cast("string")), ",").alias("indices"), "max_internal_gap_ms", "text_chars")


@query(v.oracle("v_seg") + ISLANDS + " select recording_id, start_ms, end_ms, segment_count from cand")
def candidate_session_window(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.session_candidates(v.segments(spark, sf)).select(KEY, "start_ms", "end_ms", "segment_count")


@query(v.oracle("v_hyp") + ISLANDS + """, acc as (select recording_id, count(*) filter (label <> 'unknown') as assigned, count(*) as segments from v_hyp group by 1)
select recording_id, count(*) as candidates, cast(sum(end_ms - start_ms) as bigint) as speech_ms, any_value(assigned) as assigned, any_value(segments) as segments, round(any_value(assigned) / greatest(1, any_value(segments)), 6) as coverage
from cand join acc using (recording_id) group by recording_id""")
def candidate_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: regions of every recording and how many of its segments were attributed."""
    hyp = v.hypotheses(spark, sf)
    acc = hyp.groupBy(KEY).agg(F.count_if(F.col("label") != "unknown").alias("assigned"), F.count(F.lit(1)).alias("segments"))
    per = windows.candidates(hyp).groupBy(KEY).agg(F.count(F.lit(1)).alias("candidates"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    return per.join(acc, KEY).withColumn("coverage", F.round(F.col("assigned") / F.greatest(F.lit(1), F.col("segments")), 6))


@query(v.oracle("v_seg") + """, s as (select recording_id, input_index, case when input_index % 6 = 5 then 'same' else 'seg-' || cast(input_index as varchar) end as id, start_ms, case when input_index % 9 = 8 then start_ms else end_ms end as end_ms, case when input_index % 7 = 6 then 2.0e0 else 0.5e0 end as confidence from v_seg
  union all select recording_id, input_index + 1000, 'same', start_ms, end_ms, null from v_seg where input_index = 5),
c as (select *, count(*) over (partition by recording_id, id) as n, 60000 as duration_ms from s)
select recording_id, input_index, 'duplicate_id' as violation from c where n > 1 union all select recording_id, input_index, 'invalid_range' from c where end_ms <= start_ms
union all select recording_id, input_index, 'confidence_out_of_range' from c where confidence > 1 union all select recording_id, input_index, 'beyond_audio' from c where end_ms > duration_ms""")
def segment_validation(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    one = s.select(KEY, "input_index", F.when(F.col("input_index") % 6 == 5, "same").otherwise(F.concat(F.lit("seg-"), F.col("input_index").cast("string"))).alias("id"), "start_ms", F.when(F.col("input_index") % 9 == 8, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"), F.when(F.col("input_index") % 7 == 6, 2.0).otherwise(0.5).alias("confidence"))
    two = s.filter("input_index = 5").select(KEY, (F.col("input_index") + 1000).alias("input_index"), F.lit("same").alias("id"), "start_ms", "end_ms", F.lit(None).cast("double").alias("confidence"))
    return windows.validated(one.unionByName(two), s.select(KEY).distinct().withColumn("duration_ms", F.lit(60000)))


@query(v.oracle("v_seg") + " select recording_id, input_index, text = '' as is_empty, end_ms - start_ms >= 1500 as is_inferred from v_seg where text = '' or end_ms - start_ms < 1500")
def empty_text_and_min_duration(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    return s.filter("text = '' or end_ms - start_ms < 1500").select(KEY, "input_index", (F.col("text") == "").alias("is_empty"), (F.col("end_ms") - F.col("start_ms") >= 1500).alias("is_inferred"))


# --- window scores -----------------------------------------------------------------------------------------------

SCORED = """, pen as (select *, (duration_ms < 1200) as r1, (speech_ratio < 0.65) as r2, (overlap_ms > 0 or list_contains(flags, 'residual_overlap')) as r3, (change_point_count > 0) as r4, coalesce(loudness_db < -50, true) as r5,
 case when duration_ms >= 3000 then 0 when duration_ms >= 2000 then 5 when duration_ms >= 1200 then 15 else 0 end
 + case when speech_ratio >= 0.85 then 0 when speech_ratio >= 0.75 then 8 when speech_ratio >= 0.65 then 18 else 0 end
 + case when loudness_std_db <= 8 then 0 when loudness_std_db <= 12 then 8 when loudness_std_db <= 16 then 18 else 30 end
 + case when left_sil < 80 then 3 else 0 end + case when right_sil < 80 then 3 else 0 end
 + case when list_contains(flags, 'tiny_interval') then 15 else 0 end + case when list_contains(flags, 'low_speech_ratio') then 18 else 0 end + case when list_contains(flags, 'unstable_loudness') then 10 else 0 end as penalty from v_win),
sc as (select *, round(greatest(0.0e0, 100.0e0 - penalty), 2) as score, r1 or r2 or r3 or r4 or r5 as rejected from pen),
tiered as (select *, case when rejected then 'rejected' when score >= 80 then 'clean' when score >= 65 then 'usable' when score >= 50 then 'weak' else 'rejected' end as tier,
 list_filter([case when r1 then 'duration_too_short' end, case when r2 then 'speech_ratio_too_low' end, case when r3 then 'overlap_detected' end, case when r4 then 'speaker_change_detected' end, case when r5 then 'loudness_too_low' end], lambda x: x is not null) as rejects from sc)"""


@query(v.oracle("v_win") + SCORED + " select event_id, score, tier, tier in ('clean', 'usable') as accepted, array_to_string(rejects, ',') as reject_reasons from tiered")
def window_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return windows.scored(v.windows(spark, sf)).select("event_id", "score", "tier", "accepted", F.array_join("reject_reasons", ",").alias("reject_reasons"))


@query(v.oracle("v_win") + SCORED + " select tier, count(*) as n from tiered group by 1")
def window_tier_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return windows.histogram(windows.scored(v.windows(spark, sf)), "tier", "tier")


@query(v.oracle("v_win") + SCORED + " select reason, count(*) as n from (select unnest(rejects) as reason from tiered) group by 1")
def window_reject_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return windows.histogram(windows.scored(v.windows(spark, sf)), "reject_reasons", "reason")


@query(v.oracle("v_win") + " select flag, count(*) as n from (select unnest(flags) as flag from v_win) group by 1")
def window_flag_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return windows.histogram(v.windows(spark, sf), "flags", "flag")


@query(v.oracle("v_win") + SCORED + " select event_id, tier, case tier when 'clean' then 1.0e0 else 0.7e0 end as weight from tiered where tier in ('clean', 'usable')")
def gold_selection(spark: SparkSession, sf: str) -> DataFrame:
    return windows.gold(windows.scored(v.windows(spark, sf))).filter("skip_reason is null").select("event_id", "tier", "weight")


@query(v.oracle("v_win") + SCORED + " select case when tier in ('clean', 'usable') then 'gold' else 'tier_not_gold' end as outcome, count(*) as n from tiered group by 1")
def gold_skip_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.gold(windows.scored(v.windows(spark, sf)))
    return windows.histogram(rows.withColumn("outcome", F.coalesce("skip_reason", F.lit("gold"))), "outcome", "outcome")


# --- intervals ---------------------------------------------------------------------------------------------------


@query(v.oracle("v_seg") + """, m as (select *, max(end_ms) over (partition by recording_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as m from v_seg),
i as (select *, sum(case when start_ms > m then 1 else 0 end) over (partition by recording_id order by start_ms, end_ms rows unbounded preceding) as island from m)
select recording_id, min(start_ms) as start_ms, max(end_ms) as end_ms from i group by recording_id, island""")
def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.union(v.segments(spark, sf)).select(KEY, "start_ms", "end_ms")


@query(v.oracle("v_seg") + ISLANDS + """ select s.recording_id, s.input_index, printf('asr_candidate_%03d', cast(c.island as int)) as candidate_id, greatest(0, least(s.end_ms, c.end_ms) - greatest(s.start_ms, c.start_ms)) as overlap_ms
from v_seg s join cand c on s.recording_id = c.recording_id and c.start_ms < s.end_ms and c.end_ms > s.start_ms""")
def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    pairs = intervals.overlap_join(s.select(KEY, "input_index", "start_ms", "end_ms"), windows.candidates(s).select(KEY, "candidate_id", "start_ms", "end_ms"), bucket_ms=10_000)
    return pairs.select(KEY, "input_index", "candidate_id", intervals.overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("right_start_ms"), F.col("right_end_ms")).alias("overlap_ms"))


@query(v.oracle("v_seg") + " select a.recording_id, a.input_index as a, b.input_index as b, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) as overlap_ms from v_seg a join v_seg b on a.recording_id = b.recording_id and a.input_index < b.input_index and a.start_ms < b.end_ms and b.start_ms < a.end_ms")
def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    pairs = intervals.overlap_join(s.select(KEY, F.col("input_index").alias("a"), "start_ms", "end_ms"), s.select(KEY, F.col("input_index").alias("b"), "start_ms", "end_ms"), bucket_ms=10_000)
    return pairs.filter("a < b").select(KEY, "a", "b", intervals.overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("right_start_ms"), F.col("right_end_ms")).alias("overlap_ms"))


@query(v.oracle("v_seg") + """, w as (select *, max(end_ms) over x as latest, arg_max(speaker, end_ms) over x as who from v_seg window x as (partition by recording_id order by start_ms, end_ms, speaker rows between unbounded preceding and 1 preceding))
select recording_id, coalesce(bool_or(start_ms < latest and speaker <> who), false) as has_overlap from w group by 1""")
def overlap_sweep_flag(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.sweep(v.segments(spark, sf))


@query(v.oracle("v_seg") + ISLANDS + """, d as (select recording_id, max(end_ms) as duration_ms from v_seg group by 1),
c as (select cand.recording_id, cand.end_ms, duration_ms, unnest(generate_series(cand.start_ms, cand.end_ms - 1, 5000)) as core_start from cand join d on d.recording_id = cand.recording_id),
r as (select *, least(end_ms, core_start + 5000) as core_end, greatest(0, core_start - 2500) as rs, least(duration_ms, greatest(0, core_start - 2500) + 10000) as read_end from c)
select recording_id, core_start, core_end, case when read_end - rs < 10000 and read_end = duration_ms then greatest(0, read_end - 10000) else rs end as read_start, read_end from r""")
def sliding_inference_ranges(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    rows = windows.candidates(s).join(s.groupBy(KEY).agg(F.max("end_ms").alias("duration_ms")), KEY)
    return intervals.sliding(rows, 10_000, 5_000, F.col("duration_ms")).select(KEY, "core_start", "core_end", "read_start", "read_end")


@query(v.oracle("v_frame") + ", c as (select recording_id, min(start_ms) as lo, max(end_ms) as hi from v_frame group by 1), k as (select recording_id, unnest(generate_series(lo, hi - 1, 5000)) as core_start, hi from c) select f.recording_id, k.core_start, count(*) as n_frames from v_frame f join k on f.recording_id = k.recording_id and (f.start_ms + f.end_ms) // 2 >= core_start and (f.start_ms + f.end_ms) // 2 < least(hi, core_start + 5000) group by 1, 2")
def chunk_core_frames(spark: SparkSession, sf: str) -> DataFrame:
    f = v.frames(spark, sf)
    span = f.groupBy(KEY).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    cores = intervals.sliding(span, 10_000, 5_000, F.col("end_ms")).select(KEY, "core_start", F.col("core_start").alias("start_ms"), F.col("core_end").alias("end_ms"))
    centre = f.select(KEY, F.expr("(start_ms + end_ms) div 2").alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 1)
    return intervals.overlap_join(centre, cores, bucket_ms=20_000).groupBy(KEY, "core_start").agg(F.count(F.lit(1)).alias("n_frames"))


# --- frame timelines ---------------------------------------------------------------------------------------------

BLOCKED = """, st as (select *, sum(case when active >= 2 then 1 else 0 end) over (partition by recording_id order by start_ms) as stretch from v_frame),
si as (select *, sum(case when active = 0 then end_ms - start_ms else 0 end) over (partition by recording_id, stretch order by start_ms) as silence from st),
one as (select *, lag(dom) over y as old, lag(end_ms) over y as old_end, lag(silence) over y as old_silence from si where active = 1 window y as (partition by recording_id, stretch order by start_ms)),
raw as (select recording_id, start_ms - 200 as start_ms, end_ms + 200 as end_ms from v_frame where active >= 2
 union all select recording_id, greatest(old_end, start_ms) - 200, greatest(old_end, start_ms) + 200 from one where old <> '' and dom <> '' and old <> dom and silence - old_silence <= 500),
rm as (select *, max(end_ms) over (partition by recording_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as m from raw),
ri as (select *, sum(case when start_ms > m then 1 else 0 end) over (partition by recording_id order by start_ms, end_ms rows unbounded preceding) as island from rm),
blocked as (select recording_id, min(start_ms) as start_ms, max(end_ms) as end_ms from ri group by recording_id, island)"""


@query(v.oracle("v_frame") + ", s as (select *, lag(dom) over (partition by recording_id order by start_ms) as old from v_frame where active = 1 and dom <> '') select recording_id, count(*) filter (old <> dom) as change_points from s group by 1")
def change_points(spark: SparkSession, sf: str) -> DataFrame:
    f = timeline.speaker_changes(v.frames(spark, sf))
    return f.filter("active = 1 and dom <> ''").groupBy(KEY).agg(F.count_if("change").alias("change_points"))


@query(v.oracle("v_frame") + BLOCKED + " select * from blocked")
def blocked_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.blocked(v.frames(spark, sf)).select(KEY, "start_ms", "end_ms")


@query(v.oracle("v_frame") + BLOCKED + """, cl as (select f.*, case when active >= 2 or exists (select 1 from blocked b where b.recording_id = f.recording_id and b.start_ms < f.end_ms and b.end_ms > f.start_ms) then 1 else 0 end as closer from v_frame f),
cs as (select *, sum(closer) over (partition by recording_id order by start_ms) as part from cl),
cq as (select *, max(case when active = 0 then end_ms end) over (partition by recording_id, part order by start_ms rows between unbounded preceding and 1 preceding) as silent_to from cs where closer = 0),
cn as (select *, lag(end_ms) over (partition by recording_id, part order by start_ms) as last from cq where active = 1),
cr as (select *, sum(case when last is null or greatest(start_ms, coalesce(silent_to, 0)) - last > 500 then 1 else 0 end) over (partition by recording_id, part order by start_ms) as run from cn)
select recording_id, min(start_ms) as start_ms, max(end_ms) as end_ms from cr group by recording_id, part, run""")
def single_speaker_runs(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.single_speaker_runs(v.frames(spark, sf))


@query(v.oracle("v_frame") + """, w as (select *, max(case when active <> 0 then end_ms end) over (partition by recording_id order by start_ms rows between unbounded preceding and 1 preceding) as voiced_before,
 min(case when active <> 0 then start_ms end) over (partition by recording_id order by start_ms rows between 1 following and unbounded following) as voiced_after, max(end_ms) over (partition by recording_id) as last, min(start_ms) over (partition by recording_id) as first from v_frame)
select event_id, start_ms - coalesce(voiced_before, first) as left_silence_ms, coalesce(voiced_after, last) - end_ms as right_silence_ms from w""")
def boundary_silence(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.boundary_silence(v.frames(spark, sf)).select("event_id", "left_silence_ms", "right_silence_ms")


@query(v.oracle("v_frame") + ", k as (select distinct recording_id, start_ms // 10000 as w from v_frame) select k.recording_id, w * 10000 as start_ms, cast(coalesce(sum(case when active >= 2 then least(f.end_ms, (w + 1) * 10000) - greatest(f.start_ms, w * 10000) end), 0) as bigint) as overlap_ms from k join v_frame f on f.recording_id = k.recording_id and f.start_ms < (w + 1) * 10000 and f.end_ms > w * 10000 group by 1, 2")
def overlap_ms_per_window(spark: SparkSession, sf: str) -> DataFrame:
    f = v.frames(spark, sf)
    w = f.select(KEY, (F.floor(F.col("start_ms") / 10_000) * 10_000).alias("start_ms")).distinct().withColumn("end_ms", F.col("start_ms") + 10_000)
    pairs = intervals.overlap_join(w, f.select(KEY, "active", "start_ms", "end_ms"), bucket_ms=10_000)
    part = F.when(F.col("active") >= 2, intervals.overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("right_start_ms"), F.col("right_end_ms"))).otherwise(0)
    return pairs.groupBy(KEY, "start_ms").agg(F.sum(part).alias("overlap_ms"))


#: Frames by candidate (here: the minutes of a recording), as if each were a recording of its own.
OWN = ", own as (select recording_id * 1000000 + start_ms // 60000 as recording_id, start_ms, end_ms, active, dom, power from (select f.*, case when e.event_id % 7 = 0 then 0.0e0 else e.value * e.value * 1000 end as power from v_frame f join events e using (event_id)))"
RUNS = """, cl as (select f.*, case when active >= 2 or exists (select 1 from blocked b where b.recording_id = f.recording_id and b.start_ms < f.end_ms and b.end_ms > f.start_ms) then 1 else 0 end as closer from own f),
cs as (select *, sum(closer) over (partition by recording_id order by start_ms) as part from cl),
cq as (select *, max(case when active = 0 then end_ms end) over (partition by recording_id, part order by start_ms rows between unbounded preceding and 1 preceding) as silent_to from cs where closer = 0),
cn as (select *, lag(end_ms) over (partition by recording_id, part order by start_ms) as last from cq where active = 1),
cr as (select *, sum(case when last is null or greatest(start_ms, coalesce(silent_to, 0)) - last > 500 then 1 else 0 end) over (partition by recording_id, part order by start_ms) as run from cn),
runs as (select recording_id, min(start_ms) as start_ms, max(end_ms) as end_ms from cr group by recording_id, part, run),
met as (select r.recording_id, r.start_ms, r.end_ms, f.start_ms as fs, f.end_ms as fe, f.active, f.dom, case when f.power <= 0 then -120 else 20 * log10(sqrt(f.power) / 32768) end as db from runs r join own f on f.recording_id = r.recording_id and f.start_ms < r.end_ms and f.end_ms > r.start_ms),
ch as (select recording_id, start_ms, count(*) filter (old <> dom) as changes from (select *, lag(dom) over (partition by recording_id, start_ms order by fs) as old from met where active = 1 and dom <> '') group by 1, 2),
st as (select recording_id, start_ms, any_value(end_ms) as end_ms, cast(coalesce(sum(case when active >= 2 then least(fe, end_ms) - greatest(fs, start_ms) end), 0) as bigint) as overlap_ms,
 round(count(*) filter (db >= -45) / greatest(1, count(*) filter (db > -90)), 4) as ratio, round(coalesce(avg(db) filter (db >= -45), avg(db) filter (db > -90)), 2) as loud, round(coalesce(stddev_pop(db) filter (db >= -45), stddev_pop(db) filter (db > -90), 0), 4) as dev from met group by 1, 2),
ed as (select r.recording_id, r.start_ms, r.start_ms - coalesce(max(case when f.active > 0 and f.end_ms <= r.start_ms then f.end_ms end), min(case when f.end_ms <= r.start_ms then f.start_ms end), r.start_ms) as lsil,
 coalesce(min(case when f.active > 0 and f.start_ms >= r.end_ms then f.start_ms end), max(case when f.start_ms >= r.end_ms then f.end_ms end), r.end_ms) - r.end_ms as rsil from runs r join own f on f.recording_id = r.recording_id group by r.recording_id, r.start_ms, r.end_ms),
win as (select st.*, coalesce(changes, 0) as changes, lsil, rsil, row_number() over (partition by st.recording_id // 1000000 order by printf('asr_candidate_%03d', cast(st.recording_id % 1000000 as int)), st.start_ms) - 1 as k from st left join ch using (recording_id, start_ms) join ed using (recording_id, start_ms))"""


def _minutes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, frames and their powers."""
    f = v.frames(spark, sf)
    c = f.groupBy(KEY, F.floor(F.col("start_ms") / 60_000).alias("m")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).withColumn("candidate_id", F.format_string("asr_candidate_%03d", "m"))
    value = v.table(spark, sf, "events").select("event_id", "value")
    power = f.join(value, "event_id").select(KEY, "start_ms", "end_ms", F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("value") * F.col("value") * 1000).alias("power"))
    return c, f.drop("event_id"), power


@query(v.oracle("v_frame") + OWN + BLOCKED.replace("v_frame", "own") .replace(", st as", ", sx as").replace("from st)", "from sx)") + RUNS + """ select recording_id // 1000000 as recording_id, printf('speech_window_%03d', cast(k as int)) as window_id, start_ms, end_ms, end_ms - start_ms as duration_ms, overlap_ms, cast(changes as int) as change_point_count, lsil as boundary_left_silence_ms, rsil as boundary_right_silence_ms, ratio as speech_ratio, loud as loudness_db, dev as loudness_std_db,
array_to_string(list_filter([case when end_ms - start_ms < 1200 then 'tiny_interval' end, case when ratio < 0.75 then 'low_speech_ratio' end, case when overlap_ms > 0 then 'residual_overlap' end, case when changes > 0 then 'residual_speaker_change' end, case when dev > 10 then 'unstable_loudness' end], lambda x: x is not null), ',') as flags from win""")
def candidate_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Frames split into single-speaker windows per candidate, with all that scoring needs."""
    rows = timeline.built(*_minutes(spark, sf)).withColumn("flags", F.array_join("flags", ","))
    return rows.select(KEY, "window_id", "start_ms", "end_ms", "duration_ms", "overlap_ms", "change_point_count", "boundary_left_silence_ms", "boundary_right_silence_ms", "speech_ratio", "loudness_db", "loudness_std_db", "flags")


EVENTS = BLOCKED.replace("v_frame", "own")


@query(v.oracle("v_frame") + OWN + EVENTS + ", ev as (select recording_id // 1000000 as recording_id, 'blocked_interval' as reason from blocked union all select distinct recording_id, 'no_segmentation_frames' from v_frame) select recording_id, reason, count(*) as n from ev group by 1, 2")
def split_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Each recording also has one candidate without frames."""
    return timeline.event_counts(timeline.split_events(*_with_empty(spark, sf)))


@query(v.oracle("v_frame") + OWN + EVENTS + """, ev as (select recording_id // 1000000 as recording_id, printf('asr_candidate_%03d', cast(recording_id % 1000000 as int)) as candidate_id, 'blocked_interval' as reason, start_ms from blocked union all select distinct recording_id, 'asr_candidate_none', 'no_segmentation_frames', null from v_frame)
select recording_id, candidate_id, reason, start_ms from ev qualify row_number() over (partition by recording_id order by candidate_id, start_ms nulls first) <= 120""")
def split_events_first(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.first_events(timeline.split_events(*_with_empty(spark, sf))).select(KEY, "candidate_id", "reason", "start_ms")


def _with_empty(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c, f, _ = _minutes(spark, sf)
    none = f.select(KEY).distinct().select(KEY, F.lit(-2000).cast("long").alias("start_ms"), F.lit(-1000).cast("long").alias("end_ms"), F.lit("asr_candidate_none").alias("candidate_id"))
    return c.select(KEY, "start_ms", "end_ms", "candidate_id").unionByName(none), f


@query(v.oracle("v_frame") + OWN + EVENTS + RUNS.split(",\nmet as")[0] + """, n as (select recording_id, count(*) as n from runs group by 1), c as (select distinct recording_id from own)
select c.recording_id // 1000000 as recording_id, printf('asr_candidate_%03d', cast(c.recording_id % 1000000 as int)) as candidate_id, case when c.recording_id % 5 = 0 then 'inference_failed' when n > 0 then 'success' else 'empty' end as status, case when c.recording_id % 5 = 0 then 0 else coalesce(n, 0) end as window_count from c left join n using (recording_id)
union all select distinct recording_id, 'asr_candidate_none', 'empty', 0 from v_frame""")
def candidate_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth candidate's inference fails and spoils no other."""
    c, f = _with_empty(spark, sf)
    failed = c.filter("candidate_id <> 'asr_candidate_none'").filter((F.col(KEY) * 1_000_000 + F.substring("candidate_id", 15, 9).try_cast("long")) % 5 == 0).select(KEY, "candidate_id", F.lit("RuntimeError").alias("error"))
    return timeline.candidate_results(c, timeline.built(c, f), failed).drop("error")


P7 = "select vec_id, list_transform(embedding[1:7]::double[], lambda x: (x + 1) * (case when vec_id % 2 = 0 then 1 else 0.05e0 end)) as p from embeddings"


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "embeddings")
    return e.select("vec_id", F.expr("transform(slice(cast(embedding as array<double>), 1, 7), x -> (x + 1) * if(vec_id % 2 = 0, 1D, 0.05D))").alias("p"))


@query(f"with t as ({P7}), k as (select *, list_position(p, list_max(p)) - 1 as k from t) select vec_id, [0,1,1,1,2,2,2][k + 1] as active, ['','speaker_0','speaker_1','speaker_2','speaker_0','speaker_0','speaker_1'][k + 1] as dom, round(list_max(p), 6) as confidence from k")
def powerset_decode(spark: SparkSession, sf: str) -> DataFrame:
    active, dom, conf = timeline.powerset(F.col("p"))
    return _shares(spark, sf).select("vec_id", active.alias("active"), dom.alias("dom"), F.round(conf, 6).alias("confidence"))


@query(f"with t as ({P7}), e as (select *, bool_and(list_min(p) >= 0 and list_max(p) <= 1 and list_sum(p) > 0 and list_sum(p) <= 1.2) over (partition by vec_id % 40) as shares, list_transform(p, lambda x: exp(x - list_max(p))) as e from t) select vec_id, shares, round(case when shares then p[1] else e[1] / list_sum(e) end, 6) as first, round(case when shares then p[7] else e[7] / list_sum(e) end, 6) as last from e")
def softmax_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = vx.softmax_rows(_shares(spark, sf).withColumn("chunk", F.col("vec_id") % 40), "p", ("chunk",))
    return rows.select("vec_id", "shares", F.round(F.col("p")[0], 6).alias("first"), F.round(F.col("p")[6], 6).alias("last"))


@query("""with f as (select user_id as recording_id, -110 + value * 1.0009765625e0 as db from events), k as (select *, db > -90 as kept, db >= -45 as speech from f)
select recording_id, count(*) filter (kept) as n_kept, count(*) filter (kept and speech) as n_speech, round((count(*) filter (kept and speech)) / greatest(1, count(*) filter (kept)), 4) as speech_ratio,
round(coalesce(avg(db) filter (kept and speech), avg(db) filter (kept)), 2) as loudness_db, round(coalesce(stddev_pop(db) filter (kept and speech), stddev_pop(db) filter (kept), 0), 4) as loudness_std_db from k group by 1""")
def loudness_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").select(F.col("user_id").alias(KEY), "value")
    return timeline.loudness(e, db=-110 + F.col("value") * 1.0009765625)


# --- vectors and clusters ----------------------------------------------------------------------------------------

COS = "list_dot_product(a.u, b.u) / sqrt(list_dot_product(a.u, a.u)) / sqrt(list_dot_product(b.u, b.u))"
UNIT = ", un as (select recording_id, vec_id, label, weight, start_ms, duration_ms, loudness_db, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) as u from v_gold)"
PAIRS = f", pr as (select a.recording_id, a.vec_id as i, b.vec_id as j, {COS} as cos, a.weight as wi, b.weight as wj from un a join un b on a.recording_id = b.recording_id and a.vec_id <> b.vec_id), af as (select *, power(greatest(0, least(1, cos)), 2) * sqrt(wi * wj) as affinity from pr), nn as (select *, row_number() over (partition by recording_id, i order by round(affinity, 9) desc, j) as rank from af qualify rank <= 8)"
CENTRES = """, dm as (select recording_id, label, weight, unnest(u) as x, unnest(range(1, 65)) as dim from un), sm as (select recording_id, label, dim, sum(weight * x) as x from dm group by 1, 2, 3),
ce as (select recording_id, label, list_transform(list(x order by dim), lambda y: y / sqrt(list_sum(list_transform(list(x), lambda z: z * z)))) as centre from sm group by 1, 2),
di as (select un.*, centre, list_dot_product(u, centre) as cos, 1 - list_dot_product(u, centre) as distance from un join ce using (recording_id, label)),
ru as (select *, sum(weight) over (partition by recording_id, label order by distance, vec_id rows unbounded preceding) as run, sum(weight) over (partition by recording_id, label) as total from di),
qq as (select recording_id, label, min(case when run >= 0.7e0 * total then distance end) as q0, min(case when run >= 0.9e0 * total then distance end) as q1 from ru group by 1, 2),
me as (select recording_id, label, arg_max(vec_id, (round(cos, 12), -vec_id)) as medoid_id from di group by 1, 2),
ne as (select a.recording_id, a.label, min(1 - list_dot_product(a.centre, b.centre)) as nearest from ce a join ce b on a.recording_id = b.recording_id and a.label <> b.label group by 1, 2),
ag as (select recording_id, label, count(*) as sample_count, min(vec_id) as first_id, sum(cos * weight) / sum(weight) as conc, sum(distance * weight) / sum(weight) as intra, sum(weight) as w, sum(distance * weight) as dw, cast(sum(duration_ms) as bigint) as speech_ms, round(avg(loudness_db), 2) as mean_loudness_db, min(start_ms) as first_start_ms from di group by 1, 2),
an as (select ag.*, q0, q1, medoid_id, nearest, ce.centre as centre, di.u as medoid from ag join qq using (recording_id, label) join me using (recording_id, label) join ce using (recording_id, label) join di on di.recording_id = ag.recording_id and di.vec_id = medoid_id left join ne on ne.recording_id = ag.recording_id and ne.label = ag.label)"""


@query(v.oracle("v_gold") + UNIT + PAIRS + " select recording_id, count(*) as n_pairs, round(median(cos), 6) as median_cosine from pr where i < j group by 1")
def cosine_pairs_median(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.median_cosine(v.gold(spark, sf))


@query(v.oracle("v_gold") + UNIT + PAIRS + " select recording_id, i, j, rank, round(affinity, 6) as affinity from nn")
def knn_neighbors_top8(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.neighbours(v.gold(spark, sf)).withColumn("affinity", F.round("affinity", 6))


@query(v.oracle("v_gold") + UNIT + PAIRS + " select recording_id, least(i, j) as src, greatest(i, j) as dst, round(max(affinity), 6) as affinity from nn group by 1, 2, 3")
def affinity_edges(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.affinity_edges(v.gold(spark, sf)).withColumn("affinity", F.round("affinity", 6))


@query(v.oracle("v_gold") + UNIT + CENTRES + " select recording_id, label, round(q0, 6) + 0.0e0 as core, round(q1, 6) + 0.0e0 as boundary from qq")
def weighted_quantile_radii(spark: SparkSession, sf: str) -> DataFrame:
    q = clusters.lower_quantiles(clusters.with_distance(clusters.usable(v.gold(spark, sf))), "distance", (0.7, 0.9))
    return q.select(KEY, "label", F.round("q0", 6).alias("core"), F.round("q1", 6).alias("boundary"))


@query(v.oracle("v_gold") + UNIT + CENTRES + ", d as (select recording_id, label, unnest(range(1, 65)) as dim, centre from ce) select recording_id, label, dim - 1 as dim, round(centre[dim], 6) + 0.0e0 as x from d")
def weighted_centroid(spark: SparkSession, sf: str) -> DataFrame:
    c = clusters.centres(clusters.usable(v.gold(spark, sf)))
    return c.select(KEY, "label", F.posexplode("centre").alias("dim", "x")).select(KEY, "label", F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


@query(v.oracle("v_gold") + UNIT + CENTRES + " select * from me")
def cluster_medoid(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.medoids(clusters.with_distance(clusters.usable(v.gold(spark, sf)))).select(KEY, "label", "medoid_id")


ANCHORS = """ select recording_id, label, sample_count, medoid_id, round(intra, 4) + 0.0e0 as intra_mean_dist, round(greatest(0, least(1, conc * (1 - q1))), 4) as purity_score, round(q0, 4) + 0.0e0 as core_radius, round(q1, 4) + 0.0e0 as boundary_radius,
round(conc, 4) as concentration, round(nearest, 4) + 0.0e0 as nearest_other_dist, round(nearest - round(intra, 4), 4) + 0.0e0 as margin, speech_ms, mean_loudness_db, first_start_ms from an"""


@query(v.oracle("v_gold") + UNIT + CENTRES + ANCHORS)
def speaker_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.anchors(v.gold(spark, sf)).drop("centre", "medoid", "accept_radius", "first_id")


@query(v.oracle("v_gold") + UNIT + CENTRES + " select recording_id, count(*) as cluster_count, round(sum(dw) / sum(w), 6) + 0.0e0 as mean_intra_dist, round(avg(conc), 6) as mean_concentration, round(min(nearest), 6) as min_nearest_other_dist from an group by 1")
def cluster_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.cluster_metrics(v.gold(spark, sf))


@query(v.oracle("v_gold") + UNIT + CENTRES + " select recording_id, label, round(nearest, 6) as nearest from ne")
def nearest_other(spark: SparkSession, sf: str) -> DataFrame:
    n = clusters.nearest_other(clusters.centres(clusters.usable(v.gold(spark, sf))))
    return n.select(KEY, "label", F.round("nearest", 6).alias("nearest"))


@query(v.oracle("v_gold") + ", f as (select recording_id, label, min(vec_id) as first_id from v_gold group by 1, 2) select recording_id, label, row_number() over (partition by recording_id order by first_id) - 1 as compact from f")
def label_compaction(spark: SparkSession, sf: str) -> DataFrame:
    f = v.gold(spark, sf).groupBy(KEY, "label").agg(F.min("vec_id").alias("first_id"))
    return f.select(KEY, "label", (F.row_number().over(Window.partitionBy(KEY).orderBy("first_id")) - 1).cast("long").alias("compact"))


@query(v.oracle("v_gold") + ", f as (select recording_id, label, min(start_ms) as s, min(vec_id) as i from v_gold group by 1, 2) select recording_id, label, 'local_spk_' || cast(row_number() over (partition by recording_id order by s, i) - 1 as varchar) as local_label from f")
def speaker_relabel(spark: SparkSession, sf: str) -> DataFrame:
    f = v.gold(spark, sf).groupBy(KEY, "label").agg(F.min("start_ms").alias("first_start"), F.min("vec_id").alias("first_id"))
    return clusters.relabelled(f).select(KEY, "label", "local_label")


@query()
def nme_speaker_count(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.k_candidates(v.gold(spark, sf)).select(KEY, "k_nme").distinct()


@query()
def spherical_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.speakers(v.gold(spark, sf)).select(KEY, "vec_id", "label")


@query()
def kmeans_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """What spherical_kmeans gives, by passes over all recordings' blocks at once."""
    return kmeans.speakers(v.gold(spark, sf)).select(KEY, "vec_id", "label")


@query()
def k_selection(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.k_candidates(v.gold(spark, sf))


# --- assignment --------------------------------------------------------------------------------------------------

TOP2 = """, sd as (select s.recording_id, s.vec_id, label, first_id, least(1 - list_dot_product(s.u, centre) / sqrt(list_dot_product(s.u, s.u)), 1 - list_dot_product(s.u, medoid) / sqrt(list_dot_product(s.u, s.u)) + 0.02e0) as d, round(q0, 4) as core, round(q1, 4) as boundary,
 round(nearest - round(intra, 4), 4) as anchor_margin, round(greatest(0, least(1, conc * (1 - q1))), 4) as purity, round(conc, 4) as concentration from v_sent s join an using (recording_id) where s.u is not null),
rk as (select *, row_number() over x as place, coalesce(lead(d) over x, 1.0e0) as d2 from sd window x as (partition by recording_id, vec_id order by round(d, 12), first_id)),
t2 as (select *, d as d1, greatest(0, d2 - d) as margin, greatest(0, d2 - d) / greatest(d, 0.001e0) as relative from rk where place = 1),
ba as (select s.*, label, d1, d2, margin, relative, core, boundary, anchor_margin, purity, concentration, s.u is not null as has_vector, s.recording_id in (select recording_id from an) as has_anchors from v_sent s left join t2 using (recording_id, vec_id)),
stx as (select *, case when d1 is null then 'unknown' when d1 <= core + 1e-9 and relative >= 0.35 then 'strong' when d1 <= greatest(core, boundary) + 1e-9 and relative >= 0.20 then 'normal' when d1 <= greatest(core, boundary) + 1e-9 and relative >= 0.12 then 'tentative' else 'unknown' end as strict_level from ba),
stt as (select *, case when not has_vector then 'missing_segment_embedding' when not has_anchors then 'no_gold_window_speakers' when strict_level in ('strong', 'normal') then 'segment_embedding_' || strict_level when strict_level = 'tentative' then 'inside_accept_radius_tentative' when relative < 0.12 then 'margin_too_low' else 'outside_accept_radius' end as strict_reason,
 round(case strict_level when 'strong' then least(1.0e0, 0.85e0 + least(0.15e0, 0.08e0 * relative)) when 'normal' then least(0.85e0, 0.65e0 + least(0.2e0, 0.1e0 * relative)) else 0 end, 4) as strict_confidence,
 case when duration_ms < 2000 or speech_ratio < 0.45e0 or loudness_std_db > 18 or loudness_db < -55 then 'poor' when duration_ms >= 5000 and speech_ratio >= 0.65e0 and loudness_std_db <= 12 then 'good' else 'medium' end as band from stx)"""
RECALL = """, rd as (select *, case when round(d1, 6) = 0 then 1.0e0 else round(d1, 6) end as rd, round(relative, 6) as rr, round(margin, 6) as rm, greatest(core, boundary) as radius from stt),
dc as (select *, case when strict_level in ('strong', 'normal') then 'low' when d1 is null or band = 'poor' or rd > 0.70e0 then 'unassigned'
 when strict_level = 'tentative' and rd <= radius + 1e-9 then 'medium:segment_embedding_tentative_recall'
 when strict_reason = 'outside_accept_radius' or rd > radius + 1e-9 then case when rd <= 0.62e0 + 1e-9 and rd <= radius + 0.08e0 + 1e-9 and (rr >= 0.10e0 or rm >= 0.04e0) then 'high:segment_embedding_outside_radius_recall' else 'unassigned' end
 when rd <= 0.62e0 + 1e-9 and (rr >= 0.18e0 or rm >= 0.08e0) then 'medium:segment_embedding_relaxed_margin_recall' when rd <= 0.62e0 + 1e-9 and (rr >= 0.10e0 or rm >= 0.04e0) then 'high:segment_embedding_high_risk_margin_recall' else 'unassigned' end as decision from rd),
fm as (select *, split_part(decision, ':', 1) as risk_level, split_part(decision, ':', 2) as recall_reason,
 list_filter([case when decision like '%tentative_recall' then 'tentative_margin' end, case when decision like '%outside_radius%' then 'outside_accept_radius' end, case when decision like '%outside_radius%' or decision like '%margin_recall' then 'relaxed_margin_recall' end,
 case when rd > 0.42e0 then 'high_distance_recall' end, case when rr < 0.18e0 then 'low_relative_margin' end, case when rm < 0.08e0 then 'small_absolute_margin' end, case when band = 'medium' then 'medium_quality_recall' end, case when speech_ratio < 0.65e0 then 'low_density_recall' end,
 case when loudness_std_db > 12 then 'unstable_loudness_recall' end, case when loudness_db < -50 then 'low_loudness_recall' end, case when coalesce(anchor_margin < 0.08e0, false) or purity < 0.30e0 or concentration < 0.60e0 then 'weak_speaker_anchor' end], lambda x: x is not null) as more from dc),
fl as (select *, case when risk_level in ('medium', 'high') then more when risk_level = 'low' then []::varchar[] else case strict_reason when 'missing_segment_embedding' then ['no_embedding'] when 'no_gold_window_speakers' then ['no_anchor_speaker']
 when 'outside_accept_radius' then ['outside_accept_radius'] when 'margin_too_low' then ['low_relative_margin'] else []::varchar[] end end as flags,
 case when risk_level in ('medium', 'high') then recall_reason else strict_reason end as reason, case when risk_level = 'low' then 'first_pass' when risk_level = 'unassigned' then 'unknown' else 'recall' end as source,
 case when risk_level <> 'unassigned' then null when d1 is null then 'no_candidate_speaker' when duration_ms < 2000 then 'duration_too_short_for_recall' when speech_ratio < 0.45e0 then 'speech_ratio_too_low_for_recall' when loudness_std_db > 18 then 'loudness_too_unstable_for_recall'
  when loudness_db < -55 then 'loudness_too_low_for_recall' when rd > 0.70e0 then 'distance_over_hard_cap' when strict_reason = 'outside_accept_radius' or rd > radius + 1e-9 then 'outside_accept_radius_too_far' else 'no_clear_top1_preference' end as reject_reason from fm),
fin as (select *, len(flags) as n, case when risk_level in ('medium', 'high') then 'recalled' when risk_level = 'low' then strict_level else 'unknown' end as level from fl),
rec as (select *, round(case when risk_level = 'low' then strict_confidence when risk_level = 'high' then greatest(0.42e0, least(0.58e0, 0.48e0 + least(0.06e0, 0.1e0 * rr) + least(0.03e0, 0.25e0 * rm) - 0.01e0 * greatest(0, n - 2)))
 when risk_level = 'medium' then greatest(0.52e0, least(0.70e0, 0.58e0 + least(0.07e0, 0.12e0 * rr) + least(0.04e0, 0.25e0 * rm) - 0.01e0 * greatest(0, n - 2))) else 0 end, 4) as confidence,
 round(case when strict_level = 'strong' then 0.05e0 when strict_level = 'normal' then 0.16e0 when risk_level = 'high' then least(0.85e0, 0.61e0 + 0.03e0 * n) when risk_level = 'medium' then least(0.60e0, 0.36e0 + 0.03e0 * n) else 1.0e0 end, 4) as risk_score from fin)"""
ALL = v.oracle("v_gold", "v_sent") + UNIT + CENTRES + TOP2


def _strict(spark: SparkSession, sf: str) -> DataFrame:
    return assign.strict(assign.top_two(v.sentences(spark, sf), clusters.anchors(v.gold(spark, sf))))


@query(ALL + " select recording_id, vec_id, label, round(d1, 6) + 0.0e0 as d1, round(d2, 6) + 0.0e0 as d2, round(margin, 6) + 0.0e0 as margin, round(relative, 5) + 0.0e0 as relative from ba")
def segment_top2(spark: SparkSession, sf: str) -> DataFrame:
    return _strict(spark, sf).select(KEY, "vec_id", "label", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"), F.round("margin", 6).alias("margin"), F.round("relative", 5).alias("relative"))


@query(ALL + " select recording_id, vec_id, label, strict_level, strict_reason, strict_confidence from stt")
def strict_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return _strict(spark, sf).select(KEY, "vec_id", "label", "strict_level", "strict_reason", "strict_confidence")


@query(v.oracle("v_sent") + " select band, count(*) as n from (select case when duration_ms < 2000 or speech_ratio < 0.45e0 or loudness_std_db > 18 or loudness_db < -55 then 'poor' when duration_ms >= 5000 and speech_ratio >= 0.65e0 and loudness_std_db <= 12 then 'good' else 'medium' end as band from v_sent) group by 1")
def quality_bands(spark: SparkSession, sf: str) -> DataFrame:
    b, _ = assign.band(F.col("duration_ms"), F.col("speech_ratio"), F.col("loudness_std_db"), F.col("loudness_db"))
    return windows.histogram(v.sentences(spark, sf).withColumn("band", b), "band", "band")


@query(ALL + RECALL + " select recording_id, vec_id, level, source, reason, reject_reason, risk_level, confidence, risk_score, array_to_string(flags, ',') as flags from rec")
def recall_assignment(spark: SparkSession, sf: str) -> DataFrame:
    r = assign.recalled(_strict(spark, sf))
    return r.select(KEY, "vec_id", "level", "source", "reason", "reject_reason", "risk_level", "confidence", "risk_score", F.array_join("flags", ",").alias("flags"))


@query(ALL + RECALL + """ select recording_id, vec_id, case when source = 'unknown' then 'unknown' else cast(label as varchar) end as label, case when source = 'unknown' then 'unknown' else 'assigned' end as status, source, level, reason, confidence, risk_score, risk_level, array_to_string(flags, ',') as flags,
cast(label as varchar) as candidate, round(d1, 6) + 0.0e0 as best_distance, round(d2, 6) + 0.0e0 as second_distance, case when d1 is not null then strict_level end as strict_level, case when source = 'recall' then band end as quality_band, duration_ms, speech_ratio from rec""")
def assignment_records(spark: SparkSession, sf: str) -> DataFrame:
    a = assign.records(assign.recalled(_strict(spark, sf))).select(KEY, "vec_id", "assignment.*")
    e = F.col("evidence")
    return a.select(
        KEY, "vec_id", "label", "status", "source", "level", "reason", "confidence", F.col("risk.score").alias("risk_score"), F.col("risk.level").alias("risk_level"), F.array_join("risk.flags", ",").alias("flags"),
        e["candidate_speaker"].alias("candidate"), e["best_distance"].alias("best_distance"), e["second_distance"].alias("second_distance"), e["strict_assignment_level"].alias("strict_level"), e["quality_band"].alias("quality_band"), e["duration_ms"].alias("duration_ms"), e["quality"]["speech_ratio"].alias("speech_ratio"),
    )


@query(ALL + RECALL + """, rj as (select recording_id, string_agg(reject_reason || '=' || cast(n as varchar), ',' order by reject_reason) as rejected from (select recording_id, reject_reason, count(*) as n from rec where reject_reason is not null group by 1, 2) group by 1)
select rec.recording_id, count(*) as segment_count, count(*) filter (source <> 'unknown') as assigned_count, count(*) filter (source = 'unknown') as unknown_count, count(*) filter (source <> 'first_pass') as input_unknown_count, count(*) filter (source = 'recall') as recalled_count, any_value(rejected) as rejected from rec left join rj using (recording_id) group by 1""")
def assignment_audit(spark: SparkSession, sf: str) -> DataFrame:
    a = assign.audit(assign.recalled(_strict(spark, sf)))
    return a.withColumn("rejected", F.array_join(F.transform(F.map_entries("rejected"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query(v.oracle("v_sent") + """ select name, value, n from (select * from (values ('medium_min_duration_ms', 2000.0e0), ('medium_min_speech_ratio', 0.45e0), ('medium_max_loudness_std_db', 18.0e0), ('min_loudness_db', -55.0e0), ('good_min_duration_ms', 5000.0e0), ('good_min_speech_ratio', 0.65e0), ('good_max_loudness_std_db', 12.0e0), ('soft_relative_margin', 0.18e0), ('soft_margin', 0.08e0), ('high_risk_relative_margin', 0.10e0), ('high_risk_margin', 0.04e0), ('accept_radius_slack', 0.08e0), ('soft_max_distance', 0.62e0), ('hard_max_distance', 0.70e0), ('risk_distance', 0.42e0)) t(name, value)) t,
lateral (select case when name like '%duration_ms' then count(*) filter (duration_ms >= value) when name like '%speech_ratio' then count(*) filter (speech_ratio >= value) when name like '%loudness_std_db' then count(*) filter (loudness_std_db <= value) when name = 'min_loudness_db' then count(*) filter (loudness_db >= value) end as n from v_sent) c""")
def recall_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return assign.threshold_counts(v.sentences(spark, sf))


@query(v.oracle("v_seg") + ", q as (select recording_id, input_index, (input_index % 10) / 10.0e0 as speech_ratio, -60.0e0 + input_index as loudness_db from v_seg where input_index % 3 <> 0) select s.recording_id, s.input_index, q.speech_ratio, q.loudness_db from v_seg s left join q using (recording_id, input_index)")
def segment_quality_join(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    q = s.filter("input_index % 3 <> 0").selectExpr(KEY, "input_index", "(input_index % 10) / 10D speech_ratio", "-60D + input_index loudness_db", "0D loudness_std_db")
    return assign.with_quality(s.select(KEY, "input_index"), q).drop("loudness_std_db")


@query(ALL + RECALL + " select level, count(*) as n, count(*) filter (level <> 'unknown') as assigned from rec group by 1")
def assignment_levels(spark: SparkSession, sf: str) -> DataFrame:
    return assign.levels(assign.recalled(_strict(spark, sf)))


# --- requests ----------------------------------------------------------------------------------------------------

DEDUPED = """, cl as (select *, least(end_ms, start_ms + 3000) as clip_end, row_number() over (partition by recording_id, start_ms, least(end_ms, start_ms + 3000) order by event_id) as place from v_win)"""


def _deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    return windows.deduplicated(v.windows(spark, sf), Candidates(max_clip_ms=3000), "event_id")


@query(v.oracle("v_win") + DEDUPED + " select recording_id, start_ms, clip_end, event_id from cl where place = 1")
def dedupe_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _deduplicated(spark, sf).select(KEY, "start_ms", "clip_end", "event_id")


@query(v.oracle("v_win") + DEDUPED + " select w.event_id, d.event_id as canonical_id from cl w join (select * from cl where place = 1) d on w.recording_id = d.recording_id and w.start_ms = d.start_ms and w.clip_end = d.clip_end")
def embedding_alias_join(spark: SparkSession, sf: str) -> DataFrame:
    canonical = _deduplicated(spark, sf).select(KEY, "start_ms", "clip_end", F.col("event_id").alias("canonical_id"))
    asked = v.windows(spark, sf).withColumn("clip_end", F.least(F.col("end_ms"), F.col("start_ms") + 3000))
    return asked.join(canonical, [KEY, "start_ms", "clip_end"]).select("event_id", "canonical_id")


@query(v.oracle("v_seg", "v_win") + SCORED + " select recording_id, 'sentence:' || cast(input_index as varchar) as request_id, start_ms, end_ms from v_seg where end_ms - start_ms >= 1500 union all select recording_id, 'gold:' || cast(event_id as varchar), start_ms, end_ms from tiered where tier in ('clean', 'usable')")
def window_union(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf).filter("end_ms - start_ms >= 1500").select(KEY, F.concat(F.lit("sentence:"), F.col("input_index").cast("string")).alias("request_id"), "start_ms", "end_ms")
    g = windows.gold(windows.scored(v.windows(spark, sf))).filter("skip_reason is null")
    return s.unionByName(g.select(KEY, F.concat(F.lit("gold:"), F.col("event_id").cast("string")).alias("request_id"), "start_ms", "end_ms"))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy("event_id")
    return v.windows(spark, sf).select(KEY, "event_id", (F.col("duration_ms") * 4).alias("duration_ms"), (F.col("duration_ms") * 128).alias("n_bytes"), F.row_number().over(w).cast("long").alias("place"))


@query(v.oracle("v_win").replace("with ", "with recursive ", 1) + """, p as (select recording_id, row_number() over (partition by recording_id order by event_id) as place, duration_ms * 4 as ms, duration_ms * 128 as sz from v_win),
b as (select recording_id, place, 0 as batch, 1 as n, ms, sz from p where place = 1
 union all select p.recording_id, p.place, case when b.n >= 16 or b.ms + p.ms > 60000 or b.sz + p.sz > 33554432 then b.batch + 1 else b.batch end, case when b.n >= 16 or b.ms + p.ms > 60000 or b.sz + p.sz > 33554432 then 1 else b.n + 1 end,
 case when b.n >= 16 or b.ms + p.ms > 60000 or b.sz + p.sz > 33554432 then p.ms else b.ms + p.ms end, case when b.n >= 16 or b.ms + p.ms > 60000 or b.sz + p.sz > 33554432 then p.sz else b.sz + p.sz end from b join p on p.recording_id = b.recording_id and p.place = b.place + 1)
select recording_id, place, batch from b""")
def batch_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.batches(_requests(spark, sf))


CLIPS = """, s0 as (select *, lag(end_ms) over (partition by recording_id order by start_ms, input_index) as old from v_seg), d as (select recording_id, max(end_ms) as dur from v_seg group by 1),
p as (select recording_id, start_ms as pt, bool_or(old <= start_ms) as clean from s0 where old is not null group by 1, 2), l as (select *, least(30000, dur // 9) as least_ms from d),
c1 as (select l.*, coalesce(x.clean, x.every, greatest(least_ms, least(dur - 2 * least_ms, dur // 3))) as a from l left join (select p.recording_id, arg_min(pt, (abs(pt - dur // 3), pt)) filter (clean) as clean, arg_min(pt, (abs(pt - dur // 3), pt)) as every from p join l using (recording_id) where pt between least_ms and dur - 2 * least_ms group by 1) x using (recording_id)),
c2 as (select c1.*, coalesce(x.clean, x.every, greatest(a + least_ms, least(dur - least_ms, dur * 2 // 3))) as b from c1 left join (select p.recording_id, arg_min(pt, (abs(pt - dur * 2 // 3), pt)) filter (clean) as clean, arg_min(pt, (abs(pt - dur * 2 // 3), pt)) as every from p join c1 using (recording_id) where pt between a + least_ms and dur - least_ms and pt <> a group by 1) x using (recording_id)),
clips as (select recording_id, 0 as clip, 0 as start_ms, a as end_ms from c2 union all select recording_id, 1, a, b from c2 union all select recording_id, 2, b, dur from c2)"""
REBASED = CLIPS + """, rb as (select s.recording_id, clip, input_index, greatest(0, s.start_ms - c.start_ms) as start_ms, least(c.end_ms - c.start_ms, s.end_ms - c.start_ms) as end_ms from v_seg s join clips c on c.recording_id = s.recording_id and (s.start_ms + s.end_ms) // 2 >= c.start_ms and (s.start_ms + s.end_ms) // 2 < c.end_ms)"""


@query(v.oracle("v_seg") + CLIPS + " select recording_id, cast(clip as int) as clip, cast(start_ms as bigint) as start_ms, end_ms from clips")
def clip_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return packing.clips(v.segments(spark, sf), 3)


@query(v.oracle("v_seg") + REBASED + " select recording_id, cast(clip as int) as clip, input_index, start_ms, end_ms from rb where end_ms > start_ms")
def clip_rebase(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    return packing.rebased(s, packing.clips(s, 3))


@query(v.oracle("v_seg") + REBASED + """ select 'r_' || cast(recording_id as varchar) || '_p' || cast(clip + 1 as varchar) as sample_id, count(*) as segment_count, count(distinct speaker) as speaker_count, count(*) filter (input_index % 3 = 0) as overlap_suffix_count, true as valid,
min('r_' || cast(recording_id as varchar) || '_p' || cast(clip + 1 as varchar) || '_seg_' || printf('%05d', input_index)) as first_id from (select rb.*, v.speaker from rb join v_seg v using (recording_id, input_index) where rb.end_ms > rb.start_ms) group by 1""")
def dataset_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Input and reference documents of a dataset's clips, told by their facts and the first id that the input document holds."""
    s = v.segments(spark, sf)
    cuts = packing.clips(s, 3)
    bounds = cuts.select(KEY, "clip", F.col("start_ms").alias("clip_start"), F.col("end_ms").alias("clip_end"))
    own = s.select(KEY, "input_index", F.col("start_ms").alias("source_start_ms"), F.col("end_ms").alias("source_end_ms"), "text", "speaker")
    rows = packing.rebased(s, cuts).join(bounds, [KEY, "clip"]).join(own, [KEY, "input_index"])
    flags = F.when(F.col("input_index") % 3 == 0, F.array(F.lit("overlap_suffix_normalized"))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = rows.select(F.format_string("r_%d_p%d", KEY, F.col("clip") + 1).alias("sample_id"), F.col(KEY).alias("source_id"), "clip_start", "clip_end", F.col("input_index").alias("source_index"), "start_ms", "end_ms", "source_start_ms", "source_end_ms", "text", F.col("speaker").alias("role"), F.col("speaker").alias("raw_speaker"), "speaker", flags.alias("flags"))
    made = exports.samples(rows, "weak_automatic_reviewed")
    ids = F.transform(F.from_json("input", "segments array<struct<id: string>>")["segments"], lambda x: x["id"])
    return made.select("sample_id", "segment_count", "speaker_count", "overlap_suffix_count", "valid", F.array_min(ids).alias("first_id"))


@query(v.oracle("v_win").replace("with ", "with recursive ", 1) + """, p as (select recording_id, row_number() over (partition by recording_id order by event_id) as place, duration_ms * 4 as ms, duration_ms * 128 as sz from v_win),
b as (select recording_id, place, 0 as batch, 1 as n, ms, sz, sz as own from p where place = 1
 union all select p.recording_id, p.place, case when b.n >= 16 or b.ms + p.ms > 60000 or b.sz + p.sz > 33554432 then b.batch + 1 else b.batch end, case when b.n >= 16 or b.ms + p.ms > 60000 or b.sz + p.sz > 33554432 then 1 else b.n + 1 end,
 case when b.n >= 16 or b.ms + p.ms > 60000 or b.sz + p.sz > 33554432 then p.ms else b.ms + p.ms end, case when b.n >= 16 or b.ms + p.ms > 60000 or b.sz + p.sz > 33554432 then p.sz else b.sz + p.sz end, p.sz from b join p on p.recording_id = b.recording_id and p.place = b.place + 1)
select recording_id, place, batch, sz - own as "offset" from b""")
def batch_offsets(spark: SparkSession, sf: str) -> DataFrame:
    r = _requests(spark, sf)
    return packing.with_offsets(packing.batches(r).join(r.select(KEY, "place", "n_bytes"), [KEY, "place"])).select(KEY, "place", "batch", "offset")


@query("""with q as (select vec_id % 5 as recording_id, vec_id as request, list_transform(embedding[1:8]::double[], lambda x: round(x, 3)) as samples, vec_id % 11 = 0 as late, vec_id % 17 = 0 as bad from embeddings)
select recording_id, request, case when late then 'deadline_exceeded' when bad then 'inference_failed' else 'success' end as status, case when not late and not bad then round(list_sum(samples), 6) + 0.0e0 end as first, case when not late and not bad then round(list_max(samples), 6) + 0.0e0 end as second from q""")
def inference(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of like lengths through a stand-in for a model; late requests and those at fault spoil no other."""
    e = v.table(spark, sf, "embeddings").selectExpr("vec_id % 5 recording_id", "vec_id request", "transform(slice(cast(embedding as array<double>), 1, 8), x -> if(vec_id % 17 = 0, cast('NaN' as double), round(x, 3))) samples", "16000 * (1 + vec_id % 9) n_samples", f"if(vec_id % 11 = 0, {NOW}, {NOW} + 1) deadline_ms")

    def model():
        import numpy as np

        def call(batch: list) -> list:
            x = np.array(batch)
            if np.isnan(x).any():
                raise ValueError("not a number")
            return np.stack([x.sum(axis=1), x.max(axis=1)], axis=1).tolist()

        return call

    rows = packing.inferred(e, model, NOW)
    return rows.select(KEY, "request", "status", (F.round(F.col("result")[0], 6) + 0.0).alias("first"), (F.round(F.col("result")[1], 6) + 0.0).alias("second"))


# --- evaluation --------------------------------------------------------------------------------------------------

#: A fixed mapping for the queries that don't search for the best one.
MAP = "select r.recording_id, m.label, m.speaker from (select distinct recording_id from v_seg) r cross join (values ('local_spk_1', 'user'), ('local_spk_2', 'assistant')) m(label, speaker)"
FRAMES = f""", names as ({MAP}), hyp as (select h.*, coalesce(n.speaker, h.label) as mapped from v_hyp h left join names n on n.recording_id = h.recording_id and n.label = h.label),
dur as (select recording_id, max(end_ms) as duration_ms from v_seg group by 1), fr as (select recording_id, unnest(generate_series(0, duration_ms - 1, 100)) + 50 as frame_center from dur),
col as (select distinct fr.recording_id, frame_center from fr join v_seg s on s.recording_id = fr.recording_id and (abs(frame_center - s.start_ms) <= 250 or abs(frame_center - s.end_ms) <= 250)),
kept as (select * from fr anti join col using (recording_id, frame_center)),
act as (select recording_id, frame_center, name, max(r) as in_ref, max(h) as in_hyp from (select k.recording_id, frame_center, speaker as name, 1 as r, 0 as h from kept k join v_seg s on s.recording_id = k.recording_id and start_ms <= frame_center and frame_center < end_ms
 union all select k.recording_id, frame_center, mapped, 0, 1 from kept k join hyp s on s.recording_id = k.recording_id and label <> 'unknown' and start_ms <= frame_center and frame_center < end_ms) group by 1, 2, 3),
per as (select recording_id, frame_center, sum(in_ref) as r, sum(in_hyp) as h, sum(in_ref * in_hyp) as b from act group by 1, 2),
dt as (select recording_id, sum(greatest(0, r - h)) as miss, sum(greatest(0, h - r)) as false_alarm, sum(least(r, h) - b) as confusion, sum(r) as reference_frames from per group by 1),
der as (select d.recording_id, cast(coalesce(miss, 0) as bigint) as miss, cast(coalesce(false_alarm, 0) as bigint) as false_alarm, cast(coalesce(confusion, 0) as bigint) as confusion, cast(coalesce(reference_frames, 0) as bigint) as reference_frames, round(coalesce((miss + false_alarm + confusion) / greatest(1, reference_frames), 0), 6) as der from dur d left join dt using (recording_id)),
js as (select recording_id, name, sum(in_ref * in_hyp) as b, count(*) as e from act group by 1, 2),
jer as (select recording_id, round(avg(1 - coalesce(b, 0) / greatest(1, coalesce(e, 0))), 6) as jer from (select distinct recording_id, speaker as name from v_seg) left join js using (recording_id, name) group by 1),
ov as (select h.recording_id, h.input_index, s.speaker as truth, sum(least(h.end_ms, s.end_ms) - greatest(h.start_ms, s.start_ms)) as o from hyp h join v_seg s on s.recording_id = h.recording_id and s.start_ms < h.end_ms and s.end_ms > h.start_ms group by 1, 2, 3),
tr as (select recording_id, input_index, arg_max(truth, (o, truth)) as truth from ov group by 1, 2),
ac as (select recording_id, count(*) as n, count(*) filter (label <> 'unknown') as a, count(*) filter (label <> 'unknown' and mapped = truth) as c from hyp left join tr using (recording_id, input_index) group by 1),
acc as (select recording_id, n as segments, round(c / greatest(1, a), 6) as assigned_accuracy, round(a / greatest(1, n), 6) as coverage, round((n - a) / greatest(1, n), 6) as unknown_rate from ac),
cnt as (select recording_id, count(distinct speaker) as r, count(distinct case when label <> 'unknown' then label end) as h from v_hyp group by 1),
met as (select recording_id, der, jer, case when r = h then 1.0e0 else 0.0e0 end as speaker_count_exact, cast(abs(r - h) as double) as speaker_count_mae, assigned_accuracy, coverage, unknown_rate from der join jer using (recording_id) join acc using (recording_id) join cnt using (recording_id)),
mac as (unpivot (select round(avg(der), 6) as der, round(avg(jer), 6) as jer, round(avg(speaker_count_exact), 6) as speaker_count_exact, round(avg(speaker_count_mae), 6) as speaker_count_mae, round(avg(assigned_accuracy), 6) as assigned_accuracy, round(avg(coverage), 6) as coverage, round(avg(unknown_rate), 6) as unknown_rate from met) on columns(*) into name metric value actual)"""


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return v.segments(spark, sf).select(KEY).distinct().select(KEY, F.explode(F.create_map(F.lit("local_spk_1"), F.lit("user"), F.lit("local_spk_2"), F.lit("assistant"))).alias("label", "speaker"))


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.mapped(v.hypotheses(spark, sf), _names(spark, sf))


@query(v.oracle("v_hyp") + FRAMES + " select recording_id, count(*) as n_frames from fr group by 1")
def eval_frames(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    return evaluate.frames(s, s).groupBy(KEY).agg(F.count(F.lit(1)).alias("n_frames"))


@query(v.oracle("v_hyp") + FRAMES + " select recording_id, frame_center from col")
def eval_collar(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    return evaluate.collared(s, within=evaluate.ends(s, s))


@query(v.oracle("v_hyp") + FRAMES + " select * from der")
def der_terms(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.der_terms(v.segments(spark, sf), _mapped(spark, sf))


@query(v.oracle("v_hyp") + FRAMES + " select * from jer")
def jer(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.jer(v.segments(spark, sf), _mapped(spark, sf))


@query(v.oracle("v_hyp") + FRAMES + " select recording_id, input_index, truth from tr")
def dominant_reference(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    return evaluate.dominant_reference(s, s).filter("truth is not null").select(KEY, "input_index", "truth")


@query(v.oracle("v_hyp") + FRAMES + " select * from acc")
def segment_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.accuracy(_mapped(spark, sf), v.segments(spark, sf))


@query(v.oracle("v_hyp") + FRAMES + " select * from met")
def recording_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.recording_metrics(v.segments(spark, sf), v.hypotheses(spark, sf), _names(spark, sf))


@query(v.oracle("v_hyp") + FRAMES + " select metric, actual from mac")
def macro_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.macro(evaluate.recording_metrics(v.segments(spark, sf), v.hypotheses(spark, sf), _names(spark, sf)))


@query(v.oracle("v_hyp") + FRAMES + """, g(metric, operator, threshold) as (values ('der', '<=', 0.30e0), ('jer', '<=', 0.40e0), ('speaker_count_exact', '>=', 0.80e0), ('speaker_count_mae', '<=', 0.30e0), ('assigned_accuracy', '>=', 0.85e0), ('coverage', '>=', 0.80e0), ('unknown_rate', '<=', 0.20e0))
select metric, actual, operator, threshold, case when operator = '<=' then actual <= threshold else actual >= threshold end as passed from mac join g using (metric)""")
def gate_results(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.gates(evaluate.recording_metrics(v.segments(spark, sf), v.hypotheses(spark, sf), _names(spark, sf)))


@query(v.oracle("v_hyp") + FRAMES + " select h.recording_id, h.label, s.speaker, count(distinct frame_center) as n from fr join v_hyp h on h.recording_id = fr.recording_id and h.label <> 'unknown' and h.start_ms <= frame_center and frame_center < h.end_ms join v_seg s on s.recording_id = fr.recording_id and s.start_ms <= frame_center and frame_center < s.end_ms group by 1, 2, 3")
def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.cooccurrence(v.segments(spark, sf), v.hypotheses(spark, sf))


MAPPING = """, n as (select h.recording_id, h.label, s.speaker, count(distinct frame_center) as n from fr join v_hyp h on h.recording_id = fr.recording_id and h.label <> 'unknown' and h.start_ms <= frame_center and frame_center < h.end_ms join v_seg s on s.recording_id = fr.recording_id and s.start_ms <= frame_center and frame_center < s.end_ms group by 1, 2, 3),
ls as (select recording_id, list_sort(list(distinct label) filter (label <> 'unknown')) as hs from v_hyp group by 1), rs as (select recording_id, list_sort(list(distinct speaker)) as rs from v_seg group by 1),
sd as (select recording_id, len(hs) < len(rs) as flipped, case when len(hs) < len(rs) then rs else hs end as a, case when len(hs) < len(rs) then hs else rs end as b from ls join rs using (recording_id) where len(hs) > 0),
op as (select sd.*, x.j as j1, y.j as j2, z.j as j3 from sd, range(4) x(j), range(4) y(j), range(4) z(j) where x.j <= len(b) and y.j <= len(b) and z.j <= len(b) and (len(a) >= 2 or y.j = len(b)) and (len(a) >= 3 or z.j = len(b))
 and (x.j = len(b) or x.j <> y.j) and (x.j = len(b) or x.j <> z.j) and (y.j = len(b) or y.j <> z.j) and (x.j < len(b))::int + (y.j < len(b))::int + (z.j < len(b))::int = len(b)),
pr as (select recording_id, j1, j2, j3, unnest([{'a': a[1], 'b': b[j1 + 1]}, {'a': a[2], 'b': b[j2 + 1]}, {'a': a[3], 'b': b[j3 + 1]}], recursive := true) , flipped from op),
pn as (select recording_id, j1, j2, j3, case when flipped then b else a end as label, case when flipped then a else b end as speaker from pr where a is not null and b is not null),
tt as (select pn.recording_id, j1, j2, j3, sum(coalesce(n, 0)) as total from pn left join n using (recording_id, label, speaker) group by 1, 2, 3, 4),
bs as (select * from tt qualify row_number() over (partition by recording_id order by total desc, j1, j2, j3) = 1)"""


@query(v.oracle("v_hyp") + FRAMES + MAPPING + " select pn.recording_id, label, speaker from pn join bs using (recording_id, j1, j2, j3)")
def optimal_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """At most three names a side in these views, so SQL can try all mappings."""
    return evaluate.mapping(v.segments(spark, sf), v.hypotheses(spark, sf))


REPORT = """, rc as (select recording_id as id, case when recording_id % 9 = 8 then 'failed' else 'scored' end as status, case when recording_id % 10 = 7 then null else 'src-' || cast(recording_id % 40 as varchar) end as source, case when recording_id % 6 = 1 then 'weak_auto' when recording_id % 6 = 2 then '' else 'gold' end as grade,
 ['two_speaker', case when recording_id % 3 = 0 then 'overlap' else 'single_speaker' end] as scenarios, max(end_ms) * 20 as duration_ms from v_seg group by 1),
sc as (select s, count(*) as n from (select unnest(scenarios) as s from rc) group by 1), need as (select s, greatest(0, 3 - coalesce(n, 0)) as k from (values ('single_speaker'), ('two_speaker'), ('multi_speaker'), ('overlap'), ('noisy_or_far_field')) q(s) left join sc using (s)),
ds as (select count(*) as recording_count, count(distinct source) as independent, count(*) filter (status = 'scored') as scored, coalesce(sum(duration_ms) filter (status = 'scored'), 0) as total_ms, coalesce(bool_or(grade like 'weak_%') filter (source is not null), false) as weak, array_to_string(list_sort(list(distinct grade) filter (source is not null and grade <> '')), ',') as grades from rc)
select case when independent < 20 or total_ms < 3600000 or weak or (select sum(k) from need) > 0 then 'insufficient_dataset' else 'failed' end as status, recording_count, independent as independent_recording_count, scored as scored_recording_count, cast(total_ms as bigint) as total_duration_ms, grades,
array_to_string(list_filter([case when independent < 20 then 'insufficient_independent_recordings' end, case when weak then 'weak_reference_annotations' end], lambda x: x is not null), ',') as reasons, (select string_agg(s || '=' || cast(k as varchar), ',' order by s) from need where k > 0) as missing, (select actual from mac where metric = 'der') as der, (select count(*) from mac) as n_gates from ds"""


@query(v.oracle("v_hyp") + FRAMES.replace("from der join jer using (recording_id)", "from (select * from der where recording_id % 9 <> 8) der join jer using (recording_id)") + REPORT)
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    rows = s.groupBy(KEY).agg((F.max("end_ms") * 20).alias("duration_ms")).selectExpr(
        f"{KEY} id", f"if({KEY} % 9 = 8, 'failed', 'scored') status", f"if({KEY} % 10 = 7, null, concat('src-', {KEY} % 40)) source", f"case {KEY} % 6 when 1 then 'weak_auto' when 2 then '' else 'gold' end grade",
        f"array('two_speaker', if({KEY} % 3 = 0, 'overlap', 'single_speaker')) scenarios", "duration_ms",
    )
    metrics = evaluate.recording_metrics(s, v.hypotheses(spark, sf), _names(spark, sf)).filter(f"{KEY} % 9 <> 8")
    r = evaluate.report(rows, metrics)
    d = F.col("dataset")
    missing = F.array_join(F.array_sort(F.transform(F.map_entries(d["missing_scenarios"]), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return r.select("status", *[d[c].alias(c) for c in ("recording_count", "independent_recording_count", "scored_recording_count", "total_duration_ms")], F.array_join(d["annotation_grades"], ",").alias("grades"), F.array_join(d["eligibility_reasons"], ",").alias("reasons"), missing.alias("missing"), F.col("metrics")["der"].alias("der"), F.size("gates").cast("long").alias("n_gates"))


SCENARIOS = """with r as (select recording_id, count(distinct speaker) as n, max(end_ms) as duration_ms from v_seg group by 1), w as (select *, max(end_ms) over x as latest, arg_max(speaker, end_ms) over x as who from v_seg window x as (partition by recording_id order by start_ms, end_ms, speaker rows between unbounded preceding and 1 preceding)),
o as (select recording_id, coalesce(bool_or(start_ms < latest and speaker <> who), false) as has_overlap from w group by 1),
t as (select unnest([case when n = 1 then 'single_speaker' when n = 2 then 'two_speaker' else 'multi_speaker' end, case when has_overlap then 'overlap' end]) as scenario from r join o using (recording_id))
select s.scenario, count(t.scenario) as n, greatest(0, 3 - count(t.scenario)) as missing from (values ('single_speaker'), ('two_speaker'), ('multi_speaker'), ('overlap'), ('noisy_or_far_field')) s(scenario) left join t on t.scenario = s.scenario group by 1"""


@query(v.oracle("v_seg") + SCENARIOS.replace("with r as", ", r as", 1))
def dataset_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    n = s.groupBy(KEY).agg(F.count_distinct("speaker").alias("n"), F.max("end_ms").alias("duration_ms")).join(intervals.sweep(s), KEY)
    tags = F.array_compact(F.array(F.when(F.col("n") == 1, "single_speaker").when(F.col("n") == 2, "two_speaker").otherwise("multi_speaker"), F.when(F.col("has_overlap"), "overlap")))
    return evaluate.eligibility(n.select(KEY, "duration_ms", tags.alias("scenarios")))


# --- documents, exports, tasks -----------------------------------------------------------------------------------

CLOCK = "printf('%02d:%02d:%02d{p}%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"


def _clock(x: str, p: str = ".") -> str:
    return CLOCK.replace("{x}", x).replace("{p}", p)


@query(v.oracle("v_hyp") + f" select recording_id, string_agg('[' || {_clock('start_ms')} || ' - ' || {_clock('end_ms')} || '] [' || label || '] ' || text, chr(10) order by start_ms, input_index) || chr(10) as content from v_hyp group by 1")
def export_txt(spark: SparkSession, sf: str) -> DataFrame:
    return exports.txt(v.hypotheses(spark, sf))


@query(v.oracle("v_hyp") + f", n as (select *, row_number() over (partition by recording_id order by start_ms, input_index) as k from v_hyp) select recording_id, string_agg(cast(k as varchar) || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || '[' || label || '] ' || text || chr(10), chr(10) order by k) as content from n group by 1")
def export_srt(spark: SparkSession, sf: str) -> DataFrame:
    return exports.srt(v.hypotheses(spark, sf))


@query(v.oracle("v_hyp") + f" select recording_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_clock('start_ms')} || ' --> ' || {_clock('end_ms')} || chr(10) || '[' || label || '] ' || text || chr(10), chr(10) order by start_ms, input_index) as content from v_hyp group by 1")
def export_vtt(spark: SparkSession, sf: str) -> DataFrame:
    return exports.vtt(v.hypotheses(spark, sf))


@query(v.oracle("v_hyp") + """ select recording_id, '{"schema_version":"voice_analysis_result_v1","segments":[' || string_agg('{"input_index":' || cast(input_index as varchar) || ',"normalized":{"start_ms":' || cast(start_ms as varchar) || ',"end_ms":' || cast(end_ms as varchar) || case when text is null then '' else ',"text":' || cast(to_json(text) as varchar) end || '},"assignment":{"label":"' || label || '"}}', ',' order by start_ms, input_index) || ']}' as content from v_hyp group by 1""")
def export_json(spark: SparkSession, sf: str) -> DataFrame:
    return exports.result_json(v.hypotheses(spark, sf))


@query(v.oracle("v_hyp") + f" select recording_id, string_agg('[' || {_clock('start_ms')} || ' - ' || {_clock('end_ms')} || '] [' || label || '] [confidence=' || printf('%.4f', (input_index % 4) / 4.0e0) || '] [reason=' || case when input_index % 2 = 0 then 'r' else '' end || '] [risk=low] ' || text, chr(10) order by start_ms, input_index) || chr(10) as content from v_hyp group by 1")
def export_txt_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.hypotheses(spark, sf).withColumn("confidence", (F.col("input_index") % 4) / 4.0).withColumn("reason", F.when(F.col("input_index") % 2 == 0, "r")).withColumn("risk_level", F.lit("low"))
    return exports.txt(rows, confidence=True, reason=True, risk=True)


@query(v.oracle("v_hyp") + f" select recording_id, string_agg('[' || {_clock('start_ms')} || ' - ' || {_clock('end_ms')} || '] [' || label || '] ' || text, chr(10) order by start_ms, input_index) || chr(10) as content from v_hyp group by 1")
def export_from_result(spark: SparkSession, sf: str) -> DataFrame:
    """Text from the JSON documents, which are what every other format goes by."""
    return exports.txt(exports.from_result(exports.result_json(v.hypotheses(spark, sf))))


@query(v.oracle("v_seg") + """ select recording_id, '{"schema_version":"voice_analysis_failure_v1","status":"failed","error":{"code":"AUDIO_DURATION_LIMIT","stage":"audio_probe","message":"' || cast(max(end_ms) as varchar) || ' ms","retryable":false}}' as content from v_seg group by 1 having max(end_ms) > 20000""")
def export_failure(spark: SparkSession, sf: str) -> DataFrame:
    d = v.segments(spark, sf).groupBy(KEY).agg(F.max("end_ms").alias("ms")).filter("ms > 20000")
    return exports.failures(d.select(KEY, F.lit("AUDIO_DURATION_LIMIT").alias("code"), F.lit("audio_probe").alias("stage"), F.concat(F.col("ms").cast("string"), F.lit(" ms")).alias("message"), F.lit(False).alias("retryable")))


@query("""select doc_id, case when strlen(content) <= 3000 then content end as content, case when strlen(content) > 3000 then 'SEGMENTS_TOO_LARGE' end as error from (select doc_id, '{"id":' || cast(doc_id as varchar) || case when source is null or doc_id % 2 = 0 then '' else ',"source":"' || source || '"' end || ',"n":[' || coalesce(array_to_string(range(n_chars // 4), ','), '') || ']}' as content from (select doc_id, source, cast(n_chars as bigint) as n_chars from documents))""")
def canonical_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = v.table(spark, sf, "documents").selectExpr("doc_id", "named_struct('id', doc_id, 'source', if(doc_id % 2 = 0, null, source), 'n', if(n_chars div 4 > 0, sequence(0L, cast(n_chars div 4 as bigint) - 1), cast(array() as array<bigint>))) document")
    return exports.canonical(d, most=3000)


@query(v.oracle("v_seg") + """ select recording_id, '{"schema_version":"x","n":' || cast(count(*) as varchar) || case when recording_id % 2 = 0 then ',"transcript_source":{"kind":"cloud","segments":' || cast(count(*) as varchar) || '}' else '' end || '}' as content from v_seg group by 1""")
def transcript_source(spark: SparkSession, sf: str) -> DataFrame:
    d = v.segments(spark, sf).groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).withColumn("content", F.concat(F.lit('{"schema_version":"x","n":'), F.col("n").cast("string"), F.lit("}")))
    source = F.when(F.col(KEY) % 2 == 0, F.to_json(F.struct(F.lit("cloud").alias("kind"), F.col("n").alias("segments"))))
    return exports.with_source(d, source).drop("n")


@query(v.oracle("v_seg") + """, t as (select recording_id, input_index, start_ms // 1000 * 1000 as s, end_ms // 1000 * 1000 as e, 40000 as duration_ms, trim(replace(text, chr(10), ' ')) as body, case when input_index % 5 = 4 then 'ASR混合' else speaker end as role, 'speaker_' || speaker || case when input_index % 3 = 0 then '_overlap_overlap' else '' end as raw from v_seg),
r as (select *, case when e <= s then least(duration_ms, s + 1000) else e end as e2 from t)
select recording_id, row_number() over (partition by recording_id order by input_index) - 1 as source_index, s as start_ms, least(e2, duration_ms) as end_ms, role, regexp_replace(raw, '(?:_overlap)+$', '') as speaker, body as text,
array_to_string(list_filter([case when e <= s then 'zero_duration_expanded_to_1000ms' end, case when e2 > duration_ms then 'end_clamped_to_audio' end, case when input_index % 3 = 0 then 'overlap_suffix_normalized' end, case when role = 'ASR混合' then 'ambiguous_semantic_role' end], lambda x: x is not null), ',') as flags,
case when s >= duration_ms then 'start_out_of_bounds' when least(e2, duration_ms) <= s then 'nonpositive_after_repair' end as dropped from r""")
def transcript_parse(spark: SparkSession, sf: str) -> DataFrame:
    return documents.transcript(_transcripts(spark, sf)).select(KEY, F.col("source_index").cast("long").alias("source_index"), "start_ms", "end_ms", "role", "speaker", "text", F.array_join("flags", ",").alias("flags"), "dropped")


def _transcripts(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    second = lambda c: F.substring(tx.clock(F.col(c)), 1, 8)
    raw = F.concat(F.lit("speaker_"), "speaker", F.when(F.col("input_index") % 3 == 0, "_overlap_overlap").otherwise(""))
    role = F.when(F.col("input_index") % 5 == 4, "ASR混合").otherwise(F.col("speaker"))
    line = F.concat(F.lit("**["), second("start_ms"), F.lit("–"), second("end_ms"), F.lit("] "), role, F.lit(" · "), raw, F.lit("**\n\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("input_index", line.alias("line")))), lambda x: x["line"]), "")
    head = F.concat(F.lit("# Transcript\n\n- 转写段数："), F.count(F.lit(1)).cast("string"), F.lit("\n\n"))
    return s.groupBy(KEY).agg(F.concat(head, text).alias("text")).withColumn("duration_ms", F.lit(40_000).cast("long"))


TRANSCRIPT = """, t as (select recording_id, input_index, start_ms // 1000 * 1000 as s, end_ms // 1000 * 1000 as e, 40000 as duration_ms from v_seg),
r as (select *, case when e <= s then least(duration_ms, s + 1000) else e end as e2 from t), q as (select *, case when s >= duration_ms then 'start' when least(e2, duration_ms) <= s then 'nonpositive' end as dropped from r)"""


@query(v.oracle("v_seg") + TRANSCRIPT + """ select recording_id, count(*) as declared_segment_count, count(*) as parsed_heading_count, count(*) filter (dropped is null) as usable_segment_count, count(*) filter (dropped is not null) as dropped_out_of_bounds_count, count(*) filter (dropped = 'start') as dropped_start_out_of_bounds_count,
count(*) filter (dropped = 'nonpositive') as dropped_nonpositive_after_repair_count, count(*) filter (dropped is null and e <= s) as zero_duration_repair_count, count(*) filter (dropped is null and input_index % 3 = 0) as overlap_suffix_count, count(*) filter (dropped is null and input_index % 5 = 4) as ambiguous_role_count,
true as declared_count_matches, count(*) filter (dropped is null) = count(*) as usable_count_matches_declared from q group by 1""")
def transcript_audit(spark: SparkSession, sf: str) -> DataFrame:
    raw = _transcripts(spark, sf)
    return documents.transcript_audit(raw, documents.transcript(raw))


@query("""with u as (select page_id, replace(url, '://', '://user:pw@') || case when contains(url, '?') or contains(url, '#') then '' else '?api_key=abc&page=2' end as url from pages),
p as (select page_id, regexp_extract(url, '^(https?)://(?:[^/?#]*@)?([^/?#]*)([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$', ['scheme', 'host', 'path', 'query', 'frag']) as x from u)
select page_id, x.scheme || '://' || lower(x.host) || x.path || case when x.query <> '' then '?' || regexp_replace(x.query, '(^|&)api_key=[^&]*', '\\1api_key=%3Credacted%3E') else '' end || case when x.frag <> '' then '#' || x.frag else '' end as url from p""")
def url_redaction(spark: SparkSession, sf: str) -> DataFrame:
    p = v.table(spark, sf, "pages")
    url = F.concat(F.replace("url", F.lit("://"), F.lit("://user:pw@")), F.when(F.col("url").contains("?") | F.col("url").contains("#"), "").otherwise("?api_key=abc&page=2"))
    return p.select("page_id", tx.public_url(url).alias("url"))


@query("""select page_id, '<redacted>' as api_token, cast(page_id as varchar) || '.wav' as audio_path, case when page_id % 2 = 0 then '<path>' else 'models' end as model_root, '<redacted>' as passwd, 'b.txt' as deep, 'kept text' as note,
case when page_id % 3 = 0 then 'x' else 'plain' end as listed, '<redacted>' as keyed, 'free' as other, page_id as number from pages""")
def redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Structs, arrays and maps of secrets and paths, in their public form."""
    p = v.table(spark, sf, "pages").selectExpr(
        "page_id", "url api_token", "concat('/data/', page_id, '.wav') audio_path", "if(page_id % 2 = 0, '/', 'C:/a/models/') model_root",
        "named_struct('db', named_struct('passwd', page_id, 'file', 'D:\\\\a\\\\b.txt'), 'note', 'kept text') nested", "array(named_struct('v', if(page_id % 3 = 0, '/x', 'plain'))) items", "map('my_secret', 'q', 'other', 'free') extras", "page_id number",
    )
    r = tx.redacted_frame(p)
    return r.select("page_id", "api_token", "audio_path", "model_root", "nested.db.passwd", F.col("nested.db.file").alias("deep"), "nested.note", F.col("items")[0]["v"].alias("listed"), F.col("extras")["my_secret"].alias("keyed"), F.col("extras")["other"].alias("other"), "number")


@query("select page_id, case page_id % 3 when 0 then '/data/' || cast(page_id as varchar) || '/a.wav' when 1 then 'C:\\data\\b' || cast(page_id as varchar) || '.wav' else '/data/folder/' end as path, case page_id % 3 when 0 then 'a.wav' when 1 then 'b' || cast(page_id as varchar) || '.wav' else 'folder' end as name from pages")
def path_basename(spark: SparkSession, sf: str) -> DataFrame:
    p = v.table(spark, sf, "pages")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/data/"), F.col("page_id").cast("string"), F.lit("/a.wav"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("C:\\data\\b"), F.col("page_id").cast("string"), F.lit(".wav"))).otherwise("/data/folder/")
    return p.select("page_id", path.alias("path"), F.when(tx.is_absolute(path), tx.basename(path)).alias("name"))


@query("select doc_id, case doc_id % 4 when 0 then null when 1 then 'JSON_NOT_OBJECT' else 'JSON_INVALID' end as error, case when doc_id % 4 = 0 then doc_id end as id from documents where doc_id % 4 <> 3 union all select doc_id, 'JSON_NOT_OBJECT', null from documents where doc_id % 4 = 3")
def strict_json(spark: SparkSession, sf: str) -> DataFrame:
    d = v.table(spark, sf, "documents").selectExpr("doc_id", "case doc_id % 4 when 0 then concat('{\"id\": ', doc_id, '}') when 1 then concat('[', doc_id, ']') when 2 then '{\"id\": ' else concat('\"', doc_id, '\"') end body")
    value, error = tx.strict_object(F.col("body"))
    return d.select("doc_id", error.alias("error"), F.try_variant_get(value, "$.id", "bigint").alias("id"))


@query("""select doc_id, octet_length(encode(coalesce(text, ''))) as bytes, case when octet_length(encode(coalesce(text, ''))) <= 5000 then sha256(coalesce(text, '')) end as digest, case when octet_length(encode(coalesce(text, ''))) > 5000 then 'SEGMENTS_TOO_LARGE' end as error from documents""")
def upload_digests(spark: SparkSession, sf: str) -> DataFrame:
    digest, size, error = tx.upload(F.coalesce("text", F.lit("")), "segments", 5000)
    return v.table(spark, sf, "documents").select("doc_id", size.alias("bytes"), digest.alias("digest"), error.alias("error"))


SCORED = """with w as (select conv_id as recording_id, turn, list_transform(string_split(coalesce(text, ''), ' '), lambda x: length(x)) as l from conversations)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as chunks of word lengths, and a stand-in for a model: four words a frame, whose sum tells the class. Some it refuses."""

    def model():
        def scores(samples):
            if samples[0] % 9 == 0:
                raise ValueError("refused")
            return [[float(int(sum(samples[at : at + 4])) % 7 == c) for c in range(7)] for at in range(0, len(samples), 4)]

        return scores

    lengths = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda x: F.length(x))
    c = v.table(spark, sf, "conversations").select(F.col("conv_id").alias(KEY), (F.col("turn") * 1_000_000).alias("read_start"), lengths.alias("samples"))
    end = (F.col("read_start") + F.ceil(F.size("samples") / 4) * 25).alias("read_end")
    return models.scored(c.select(KEY, "read_start", end, F.col("read_start").alias("core_start"), end.alias("core_end"), "samples"), model)


@query(SCORED + """, f as (select recording_id, turn, unnest(range(0, (len(l) + 3) // 4)) as k, l from w where l[1] % 9 > 0), c as (select *, cast(list_sum(l[4 * k + 1 : 4 * k + 4]) % 7 as int) + 1 as class from f)
select recording_id, turn * 1000000 + k * 25 as start_ms, turn * 1000000 + k * 25 + 25 as end_ms, [0, 1, 1, 1, 2, 2, 2][class] as active, ['', 'speaker_0', 'speaker_1', 'speaker_2', 'speaker_0', 'speaker_0', 'speaker_1'][class] as dom, 1.0e0 as confidence from c""")
def segmentation_frames(spark: SparkSession, sf: str) -> DataFrame:
    return models.activity(_scored(spark, sf))


@query(SCORED + " select recording_id, turn * 1000000 as read_start, turn * 1000000 + (len(l) + 3) // 4 * 25 as read_end, 'ValueError' as error from w where l[1] % 9 = 0")
def segmentation_failures(spark: SparkSession, sf: str) -> DataFrame:
    """What the model refuses is told by chunk, and spoils no other."""
    return models.failures(_scored(spark, sf))


@query("select doc_id, sha256(sha256(text) || ':local:' || lang) as digest from documents")
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "documents").select("doc_id", tx.input_digest(F.col("text"), F.lit("local"), F.col("lang")).alias("digest"))


@query(v.oracle("v_task") + """, r as (select o_orderkey as request_id, case when o_orderkey % 4 <> 0 then 'key-' || cast(o_custkey as varchar) end as k, cast((o_orderkey + 1) % 3 as varchar) as d from orders),
f as (select idempotency_key as k, arg_min(task_id, (created_at_ms, task_id)) as found_task, arg_min(input_digest, (created_at_ms, task_id)) as digest from v_task where idempotency_key is not null and status <> 'expired' group by 1)
select request_id, case when f.found_task is null then 'created' when digest = d then 'replayed' else 'conflict' end as outcome, found_task from r left join f using (k)""")
def idempotency_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    r = v.table(spark, sf, "orders").selectExpr("o_orderkey request_id", "case when o_orderkey%4<>0 then concat('key-', cast(o_custkey as string)) end idempotency_key", "cast((o_orderkey+1)%3 as string) input_digest")
    return sessions.idempotent(r, v.tasks(spark, sf)).select("request_id", "outcome", "found_task")


@query(v.oracle("v_task") + " select count(*) filter (status <> 'expired') as retained, count(*) filter (status = 'failed') as failed, count(*) filter (status in ('queued', 'running')) as active, count(*) filter (status in ('queued', 'running')) < 1 as accepts from v_task")
def task_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.occupancy(v.tasks(spark, sf))


#: Tasks of which some have no time of an end, of expiry or of a change.
KEPT = Tasks(retention_ms=3 * 86_400_000, expired_metadata_ms=40 * 86_400_000)
CLEANING = """, k as (select * replace (case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 0 else finished_at_ms end as finished_at_ms, case when o_orderkey % 3 = 0 then null else expired_at_ms end as expired_at_ms), case when o_orderkey % 7 > 1 then created_at_ms + 90000 end as updated_at_ms from v_task),
a as (select *, case when status in ('succeeded', 'failed', 'cancelled') and 820000000000 - coalesce(nullif(finished_at_ms, 0), updated_at_ms, 820000000000) >= 259200000 then 'expire' when status = 'expired' and 820000000000 - coalesce(expired_at_ms, 820000000000) >= 3456000000 then 'delete' else 'keep' end as action from k)"""


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return v.tasks(spark, sf).withColumns({
        "finished_at_ms": F.when(key % 5 == 1, 0).when(key % 5 > 1, F.col("finished_at_ms")), "expired_at_ms": F.when(key % 3 > 0, F.col("expired_at_ms")), "updated_at_ms": F.when(key % 7 > 1, F.col("created_at_ms") + 90_000),
    })


@query(v.oracle("v_task") + CLEANING + """
select task_id, case when action = 'expire' then 'expired' else status end as status, created_at_ms, case when action = 'expire' then null else finished_at_ms end as finished_at_ms, case when action = 'expire' then 820000000000 else expired_at_ms end as expired_at_ms, case when action = 'expire' then null else input_mode end as input_mode from a where action <> 'delete'""")
def cleaned_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.cleaned(_kept(spark, sf), NOW, KEPT).select("task_id", "status", "created_at_ms", "finished_at_ms", "expired_at_ms", "input_mode")


@query(v.oracle("v_task") + " select o_orderkey, row_number() over (order by created_at_ms, task_id) as turn from v_task where status in ('queued', 'running') and cancel_requested_at_ms is null and input_mode <> 'cloud_asr'")
def recovery_order(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.recovery_order(v.tasks(spark, sf)).select("o_orderkey", "turn")


@query(v.oracle("v_task") + " select status, count(*) as n, count(*) filter (cancel_requested_at_ms is not null) as cancel_requested, min(created_at_ms) as oldest_ms from v_task group by 1")
def task_state_summary(spark: SparkSession, sf: str) -> DataFrame:
    return v.tasks(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("cancel_requested_at_ms").alias("cancel_requested"), F.min("created_at_ms").alias("oldest_ms"))




@query(v.oracle("v_task") + CLEANING + " select o_orderkey, action from a")
def ttl_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.ttl_actions(_kept(spark, sf), NOW, KEPT).select("o_orderkey", "action")


@query(v.oracle("v_task") + " select o_orderkey, case when status not in ('queued', 'running') then 'none' when cancel_requested_at_ms is not null then 'cancel' when input_mode = 'cloud_asr' then 'fail:CREDENTIAL_LOST' else 'rerun' end as action from v_task")
def recovery_classification(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.recovery(v.tasks(spark, sf)).select("o_orderkey", "action")


@query("""with e as (select user_id, value, epoch_ms(ts) as ms from events)
select user_id, count(*) as n, round(median(value), 6) as median_value, round(max(value), 6) as max_value, round((arg_max(value, ms) - arg_min(value, ms)) / nullif((max(ms) - min(ms)) / 3600000.0e0, 0), 4) as slope_per_hour from e group by 1""")
def soak_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    hours = F.nullif((F.max("at") - F.min("at")) / 3600000.0, F.lit(0.0))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("value"), 6).alias("median_value"), F.round(F.max("value"), 6).alias("max_value"), F.round((F.max_by("value", "at") - F.min_by("value", "at")) / hours, 4).alias("slope_per_hour"))


@query(v.oracle("v_seg") + ", t as (select recording_id, unnest(generate_series(0, max(end_ms), 1700)) as t from v_seg group by 1) select t.recording_id, t.t, min(s.input_index) as input_index from t join v_seg s on s.recording_id = t.recording_id and s.start_ms <= t.t and t.t < s.end_ms group by 1, 2")
def playback_lookup(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    at = s.groupBy(KEY).agg(F.max("end_ms").alias("m")).select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"), F.lit(1700).cast("long"))).alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 1)
    pairs = intervals.overlap_join(at, s.select(KEY, "input_index", "start_ms", "end_ms"), bucket_ms=10_000)
    return pairs.groupBy(KEY, F.col("start_ms").alias("t")).agg(F.min("input_index").alias("input_index"))


# --- requests and small views ------------------------------------------------------------------------------------

REQ = "with q as (select event_id, user_id % 20 as recording_id, (event_id * 7919) % 3000000 as \"offset\", 2 * ((event_id * 104729) % 600000) as length from events)"


def _embed(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events")
    rows = e.select("event_id", (F.col("user_id") % 20).alias(KEY), ((F.col("event_id") * 7919) % 3_000_000).alias("offset"), (2 * ((F.col("event_id") * 104_729) % 600_000)).alias("length"))
    return requests.embed_status(rows, F.lit(3_200_000))


STATUS = REQ + """, s as (select *, case when "offset" + length > 3200000 then 'invalid_boundary' when length // 2 < 6400 then 'too_short' else 'accepted' end as status from q), a as (select *, case when status = 'accepted' then least(length // 2, 480000) end as samples from s)"""


@query(STATUS + " select event_id, status, samples from a")
def embed_request_status(spark: SparkSession, sf: str) -> DataFrame:
    return _embed(spark, sf).select("event_id", "status", "samples")


@query(STATUS + " select event_id, recording_id, row_number() over (partition by recording_id order by samples, event_id) as place from a where status = 'accepted'")
def length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return requests.length_ordered(_embed(spark, sf).filter("status = 'accepted'"), "event_id").select("event_id", KEY, "place")


@query("select o_orderkey, epoch_ms(o_orderdate) <= 820000000000 as deadline_exceeded from orders")
def deadline_drop(spark: SparkSession, sf: str) -> DataFrame:
    o = v.table(spark, sf, "orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("deadline_ms"))
    return requests.within_deadline(o, F.lit(NOW)).select("o_orderkey", "deadline_exceeded")


@query(v.oracle("v_frame") + ", r as (select recording_id, start_ms + 250 as s, start_ms + 900 as e from v_frame where event_id % 11 = 0) select event_id, case when exists (select 1 from r where r.recording_id = f.recording_id and r.s < f.end_ms and r.e > f.start_ms) then greatest(2, active) else active end as active from v_frame f")
def detected_overlap(spark: SparkSession, sf: str) -> DataFrame:
    f = v.frames(spark, sf)
    r = f.filter("event_id % 11 = 0").select(KEY, (F.col("start_ms") + 250).alias("start_ms"), (F.col("start_ms") + 900).alias("end_ms"))
    return requests.with_detected_overlap(f, r).select("event_id", "active")


@query("with p as (select vec_id, unnest(embedding[1:6]::double[]) as row, unnest(range(6)) as frame, 900 + vec_id as duration_ms from embeddings) select vec_id, cast(frame as int) as frame, cast(round_even(frame * (duration_ms / 6.0e0), 0) as bigint) as start_ms, cast(round_even((frame + 1) * (duration_ms / 6.0e0), 0) as bigint) as end_ms from p")
def prediction_frames(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 6).alias("rows"), (900 + F.col("vec_id")).alias("duration_ms"))
    return requests.prediction_frames(e, F.col("duration_ms")).select("vec_id", "frame", "start_ms", "end_ms")


@query("""with m as (select cast(doc_id as varchar) as id, case when doc_id % 3 = 0 then source end as source, case when doc_id % 4 = 0 then lang end as grade, case when doc_id % 5 < 2 then source when doc_id % 5 = 2 then 'other' end as rs, case when doc_id % 7 = 0 then 'en' end as rg from documents)
select id, coalesce(source, rs, id) as source, coalesce(grade, rg) as grade, case when source <> rs or grade <> rg then 'EVALUATION_PROVENANCE_MISMATCH' end as error from m""")
def provenance_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    d = v.table(spark, sf, "documents")
    m = d.selectExpr("cast(doc_id as string) id", "case when doc_id % 3 = 0 then source end source", "case when doc_id % 4 = 0 then lang end grade", "case when doc_id % 5 < 2 then source when doc_id % 5 = 2 then 'other' end reference_source", "case when doc_id % 7 = 0 then 'en' end reference_grade")
    return requests.provenance(m)


@query("with u as (select user_id, event_type || '-' || cast(event_id % 40 as varchar) as task, max(epoch_us(ts) // 1000) as at_ms from events group by 1, 2) select user_id, task, row_number() over (partition by user_id order by at_ms desc, task) as place from u qualify place <= 20")
def recent_tasks(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").select("user_id", F.concat_ws("-", "event_type", (F.col("event_id") % 40).cast("string")).alias("task"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return requests.recent(e).select("user_id", "task", "place")


@query(v.oracle("v_seg") + ", f as (select recording_id, speaker, min((start_ms, input_index)) as first from v_seg group by 1, 2) select recording_id, speaker, (row_number() over (partition by recording_id order by first) - 1) % 6 as colour from f")
def speaker_colours(spark: SparkSession, sf: str) -> DataFrame:
    return requests.colours(v.segments(spark, sf))


@query("select distinct label as k, vec_id % 9 + 1 as n, array_to_string(list_sort(list_distinct([greatest(1, least(6, n, label - 1)), greatest(1, least(6, n, label)), greatest(1, least(6, n, label + 1))])), ',') as ks from embeddings")
def candidate_ks(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "embeddings").select(F.col("label").alias("k"), (F.col("vec_id") % 9 + 1).alias("n")).distinct()
    return requests.candidate_ks(e).withColumn("ks", F.array_join(F.transform("ks", lambda x: x.cast("string")), ","))


@query("with w as (select url as path, length(html) as size, sha256(html) as sha from pages), f as (select url as path, length(html) + case when page_id % 10 = 0 then 1 else 0 end as size, sha256(html) as sha from pages where page_id % 13 <> 0) select path, size from w anti join f using (path, size, sha)")
def file_verification(spark: SparkSession, sf: str) -> DataFrame:
    p = v.table(spark, sf, "pages")
    wanted = p.select(F.col("url").alias("path"), F.length("html").cast("long").alias("size"), F.sha2("html", 256).alias("sha256"))
    found = p.filter("page_id % 13 <> 0").select(F.col("url").alias("path"), (F.length("html") + (F.col("page_id") % 10 == 0).cast("int")).cast("long").alias("size"), F.sha2("html", 256).alias("sha256"))
    return requests.unverified(wanted, found).select("path", "size")


@query(v.oracle("v_seg") + """, w as (select *, max(end_ms) over x as latest, arg_max(speaker, end_ms) over x as who from v_seg window x as (partition by recording_id order by start_ms, end_ms, speaker rows between unbounded preceding and 1 preceding)),
o as (select recording_id, coalesce(bool_or(start_ms < latest and speaker <> who), false) as has_overlap, count(distinct speaker) as n, bool_or(contains(speaker, 'system')) as marked from w group by 1)
select recording_id, array_to_string(list_filter([case when n = 1 then 'single_speaker' when n = 2 then 'two_speaker' else 'multi_speaker' end, case when has_overlap then 'overlap' end, case when marked then 'noisy_or_far_field' end], lambda x: x is not null), ',') as scenarios from o""")
def scenario_tags(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    return requests.scenario_tags(s.withColumn("role", F.col("speaker")), intervals.sweep(s), ("system",)).withColumn("scenarios", F.array_join("scenarios", ","))


@query(v.oracle("v_seg") + ", d as (select recording_id, max(end_ms) as duration_ms from v_seg group by 1), c as (select *, unnest(generate_series(0, duration_ms - 1, 30000)) as start_ms from d) select recording_id, start_ms, least(duration_ms, start_ms + 30000) as end_ms from c")
def pcm_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = v.segments(spark, sf).groupBy(KEY).agg(F.max("end_ms").alias("duration_ms"))
    return requests.chunks(d).select(KEY, "start_ms", "end_ms")


@query(v.oracle("v_task") + """ select task_id, '{"task_id":"' || task_id || '","status":"' || status || '","created_at_ms":' || cast(created_at_ms as varchar) || ',"finished_at_ms":' || cast(finished_at_ms as varchar) || ',"expired_at_ms":' || cast(expired_at_ms as varchar) || ',"input_mode":"' || input_mode || '"}' as task from v_task""")
def public_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return requests.public_tasks(v.tasks(spark, sf))


@query("""with r as (select o_orderkey as id, case when o_orderkey % 7 = 0 then 8000 else 16000 end as rate, case when o_orderkey % 11 = 0 then 'v0' else 'v1' end as model, case when o_orderkey % 5 = 0 then 820000000000 else 820000000001 end as deadline, 1 + o_orderkey % 3 as n from orders)
select id, case when id % 13 = 0 then 400 when rate <> 16000 then 400 when model <> 'v1' then 400 when deadline <= 820000000000 then 504 when id % 17 = 0 and n > 1 then 400 end as code,
case when id % 13 = 0 then 'invalid metadata' when rate <> 16000 then 'sample_rate must be 16000' when model <> 'v1' then 'model version mismatch' when deadline <= 820000000000 then 'request deadline exceeded' when id % 17 = 0 and n > 1 then 'duplicate window_id' end as detail from r""")
def request_errors(spark: SparkSession, sf: str) -> DataFrame:
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("request_id"))
    r = o.withColumns({"sample_rate": F.when(F.col("id") % 7 == 0, 8000).otherwise(16_000), "expected_model_version": F.when(F.col("id") % 11 == 0, "v0").otherwise("v1"), "deadline_ms": F.when(F.col("id") % 5 == 0, NOW).otherwise(NOW + 1)})
    w = o.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("id") % 3))).selectExpr("request_id", "if(id % 17 = 0, 'same', concat('w', k)) window_id", "(k - 1) * 2000 offset", "if(id % 13 = 0, 1999, 2000) length", "if(k % 2 = 0, 'gold', 'sentence') kind")
    return requests.request_errors(r, w, NOW, "v1").select("id", "code", "detail")


@query("""with a as (select o_orderkey as id, 820000000000 + o_orderkey % 3 - 1 as deadline, case when o_orderkey % 4 <> 0 then 819999999990 end as s, case when o_orderkey % 4 in (1, 2) then 819999999998 + o_orderkey % 5 end as f from orders)
select id, case when s is null and 820000000000 >= deadline then 'expired_before_inference' when f >= deadline then 'deadline_exceeded' when f is null then 'pending' else 'success' end as status from a""")
def answer_status(spark: SparkSession, sf: str) -> DataFrame:
    a = v.table(spark, sf, "orders").selectExpr("o_orderkey id", f"{NOW} + o_orderkey % 3 - 1 deadline_ms", f"if(o_orderkey % 4 <> 0, {NOW} - 10, null) started_ms", f"if(o_orderkey % 4 in (1, 2), {NOW} - 2 + o_orderkey % 5, null) finished_ms")
    return requests.answer_status(a, F.lit(NOW)).select("id", "status")


@query("""with a as (select o_orderkey as id, o_orderkey % 9 as k from orders) select id, case k when 0 then 'DEADLINE_EXCEEDED' when 1 then 'WINDOW_REFINE_TIMEOUT' when 2 then 'WINDOW_REFINE_UNAVAILABLE' when 3 then 'WINDOW_REFINE_AUTH' when 4 then 'WINDOW_REFINE_PROTOCOL' when 5 then 'WINDOW_REFINE_PROTOCOL' when 6 then 'WINDOW_REFINE_INFERENCE' when 7 then 'WINDOW_REFINE_PROTOCOL' end as error,
case when k = 3 then false when k < 8 then true end as retryable from a""")
def refine_errors(spark: SparkSession, sf: str) -> DataFrame:
    a = v.table(spark, sf, "orders").selectExpr(
        "o_orderkey id", "o_orderkey % 9 <> 2 ready", "if(o_orderkey % 9 < 2, 'timeout', 'ok') outcome", "case o_orderkey % 9 when 3 then 401 when 4 then 502 else 200 end http", "10L now_ms", "if(o_orderkey % 9 = 0, 10L, 11L) deadline_ms",
        """case o_orderkey % 9 when 5 then 'no JSON' when 6 then '{"success": false}' when 7 then '{"success": true, "speech_window_candidates": 1}' else '{"success": true, "speech_window_candidates": []}' end body""",
    )
    return requests.refine_errors(a).select("id", "error", "retryable")


@query(v.oracle("v_seg") + ", q as (select recording_id, 'sentence:' || cast(input_index as varchar) as id, start_ms, least(end_ms, start_ms + 3000) as end_ms from v_seg) select recording_id, id as request_id, row_number() over (partition by recording_id order by end_ms - start_ms, start_ms, end_ms, id) as place from q")
def client_order(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf).select(KEY, F.concat(F.lit("sentence:"), F.col("input_index").cast("string")).alias("request_id"), "start_ms", F.least(F.col("end_ms"), F.col("start_ms") + 3000).alias("end_ms"))
    return requests.client_ordered(s).select(KEY, "request_id", "place")


@query(v.oracle("v_seg") + """ select recording_id, 'window:' || cast(input_index as varchar) as window_id, cast(coalesce(sum(dur_ms * 32) over (partition by recording_id order by input_index rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", dur_ms * 32 as length, case when input_index % 2 = 1 then 'sentence' else 'gold' end as kind from v_seg""")
def load_fixture(spark: SparkSession, sf: str) -> DataFrame:
    return requests.load_fixture(v.segments(spark, sf).select(KEY, F.col("input_index").alias("place"), F.col("dur_ms").alias("duration_ms")))


@query("""with c as (select user_id % 5 as run, epoch_ms(ts) as s, epoch_ms(ts) + 200 + event_id % 1800 as f, event_id % 13 <> 0 as ok from events)
select run, count(*) filter (ok) as requests_succeeded, round((max(f) - min(s)) / 1000.0e0, 2) as elapsed_seconds, round(case when max(f) > min(s) then count(*) filter (ok) * 62 / ((max(f) - min(s)) / 1000.0e0) else 0 end, 3) as windows_per_second, round(median((f - s) / 1000.0e0) filter (ok), 3) as latency_p50_seconds, round(max((f - s) / 1000.0e0) filter (ok), 3) as latency_max_seconds from c group by 1""")
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").select((F.col("user_id") % 5).alias("run"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("started_ms"))
    return requests.load_report(e.select("run", "started_ms", (F.col("started_ms") + 200 + F.col("event_id") % 1800).alias("finished_ms"), (F.col("event_id") % 13 != 0).alias("ok")), 62)


@query(v.oracle("v_win") + DEDUPED + """, res as (select event_id as canonical, score from (select event_id, duration_ms % 7 as score from cl where place = 1) where event_id % 6 <> 0)
select w.event_id as request, d.event_id as canonical, case when r.canonical is null then 'missing_result' else 'success' end as status, r.score from cl w join (select * from cl where place = 1) d on w.recording_id = d.recording_id and w.start_ms = d.start_ms and w.clip_end = d.clip_end left join res r on r.canonical = d.event_id""")
def embedded_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every request finds the vector of the window that stood for it, or says that there is none."""
    canonical = _deduplicated(spark, sf)
    aliases = embedding_alias_join(spark, sf).select(F.col("event_id").alias("request"), F.col("canonical_id").alias("canonical"))
    results = canonical.filter("event_id % 6 <> 0").selectExpr("event_id canonical", "array(cast(duration_ms % 7 as double)) embedding", "'success' status")
    return requests.embedded(results, aliases).select("request", "canonical", "status", F.col("embedding")[0].cast("long").alias("score"))


@query()
def nme_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The gaps and eigenvalues behind each recording's number of speakers."""
    return clusters.estimates(v.gold(spark, sf)).select(KEY, "k_nme", "method", F.round("median_cosine", 6).alias("median_cosine"), F.size("gaps").alias("n_gaps"), F.size("eigenvalues").alias("n_eigenvalues"))


# --- the whole way -----------------------------------------------------------------------------------------------


@query()
def analyzed_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations from segments to attributed segments; a stand-in for a model gives each window a vector of its speaker."""
    s = v.segments(spark, sf)
    frames = s.select(KEY, "start_ms", "end_ms", F.lit(1).alias("active"), F.col("speaker").alias("dom"))
    power = spread(s.filter("dur_ms >= 30").select(KEY, "start_ms", "end_ms"), KEY).select(KEY, F.explode(F.sequence("start_ms", F.col("end_ms") - 30, F.lit(30).cast("long"))).alias("start_ms")).distinct().select(KEY, "start_ms", (F.col("start_ms") + 30).alias("end_ms"), F.lit(4e6).alias("power"))

    def embed(asked: DataFrame) -> DataFrame:
        said = intervals.overlap_join(asked.select(KEY, "request", "start_ms", "end_ms"), s.select(KEY, "start_ms", "end_ms", "speaker"))
        shared = intervals.overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("right_start_ms"), F.col("right_end_ms"))
        most = said.groupBy(KEY, "request", "start_ms").agg(F.max(F.struct(shared.alias("ms"), "speaker"))["speaker"].alias("who"))
        near = F.lit(0.02) * (F.col("start_ms") % 7)
        return most.select(KEY, "request", F.lit("success").alias("status"), F.when(F.col("who") == "user", F.array(F.lit(1.0), near, F.lit(0.0))).otherwise(F.array(near, F.lit(0.0), F.lit(1.0))).alias("embedding"))

    return analysis.analyze(s, frames, power, embed).segments.select(KEY, "input_index", "label", "confidence", "reason", "risk_level")


# --- files -------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return scratch(spark, name)


def _documents(spark: SparkSession, sf: str) -> str:
    """Segment documents, one file a recording, five of six at fault in ways of their own; the pattern that names them."""
    end = F.expr("case when recording_id % 6 = 5 and input_index = 0 then start_ms else end_ms end")
    name = F.when(F.col(KEY) % 6 != 4, F.concat(F.lit("s"), F.col("input_index").cast("string"))).otherwise("s")
    part = F.struct("input_index", F.struct(name.alias("id"), "start_ms", end.alias("end_ms"), F.coalesce("text", F.lit("")).alias("text")).alias("s"))
    d = v.segments(spark, sf).groupBy(KEY).agg(F.to_json(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"])).alias("segments"))
    head = F.when(F.col(KEY) % 6 == 1, '{"extra":1,').when(F.col(KEY) % 6 == 2, '{"schema_version":"other",').otherwise('{"schema_version":"voice_analysis_input_v1",')
    body = F.concat(head, F.lit('\n"segments":'), "segments", F.when(F.col(KEY) % 6 == 3, "").otherwise("}"))
    root = _folder(spark, "documents")
    exports.write_files(d.select(F.concat(F.col(KEY).cast("string"), F.lit(".json")).alias("path"), F.encode(body, "utf-8").alias("content")), root)
    return f"{root}/*.json"


def _number(column: str) -> Column:
    return F.regexp_extract(column, r"([0-9]+)\.[a-z]+$", 1).cast("long").alias(KEY)


@query("select conv_id as recording_id, case when conv_id % 6 in (1, 2, 3, 5) or (conv_id % 6 = 4 and count(*) > 1) then 'SEGMENTS_INVALID' end as error from conversations group by 1")
def document_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Root keys, versions, damaged JSON, repeated ids and ranges without length."""
    return documents.checked_documents(spark, _documents(spark, sf)).select(_number("recording"), "error")


@query(v.oracle("v_seg") + " select recording_id, row_number() over (partition by recording_id order by input_index) - 1 as input_index, start_ms, case when recording_id % 6 = 5 and input_index = 0 then start_ms else end_ms end as end_ms, coalesce(text, '') as text from v_seg where recording_id % 6 <> 3")
def document_segments(spark: SparkSession, sf: str) -> DataFrame:
    """What is no JSON has no segments; other faults are for document_errors to tell."""
    return documents.segment_documents(spark, _documents(spark, sf)).select(_number("recording"), F.col("input_index").cast("long").alias("input_index"), "start_ms", "end_ms", "text")


@query("select 'r' || cast(conv_id as varchar) as id, 'ref/' || cast(conv_id as varchar) || '.json' as reference_path, case when conv_id % 2 = 0 then 'overlap,two_speaker' else '' end as scenarios, case when conv_id % 4 = 1 then 'gold' end as annotation_grade from conversations where conv_id % 3 <> 0 group by conv_id")
def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each third line is blank."""
    c = v.table(spark, sf, "conversations").select("conv_id").distinct()
    scenarios = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("overlap"), F.lit("two_speaker"))).otherwise(F.array().cast("array<string>"))
    line = F.struct(F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("id"), F.concat(F.lit("ref/"), F.col("conv_id").cast("string"), F.lit(".json")).alias("reference_path"), scenarios.alias("scenarios"), F.when(F.col("conv_id") % 4 == 1, "gold").alias("annotation_grade"))
    root = _folder(spark, "manifest")
    c.select(F.when(F.col("conv_id") % 3 == 0, " \t").otherwise(F.to_json(line)).alias("value")).write.text(root)
    return documents.manifest(spark, root).select("id", "reference_path", F.array_join("scenarios", ",").alias("scenarios"), "annotation_grade")


@query("""with t as (select md5(cast(conv_id * 1000 + turn as varchar)) as task_id, conv_id * 1000 + turn as n, text from conversations)
select task_id, case when n % 2 = 0 then 'queued' else 'failed' end as status, n as created_at_ms, case when n % 3 = 0 then n + 1 end as finished_at_ms, sha256(coalesce(text, '')) as input_digest from t where n % 5 > 0 and n % 7 > 0""")
def task_facts(spark: SparkSession, sf: str) -> DataFrame:
    """A task per turn, written and read again; some files are damaged, some lie in another task's folder."""
    t = v.table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn n", "text").selectExpr("md5(cast(n as string)) task_id", "if(n % 2 = 0, 'queued', 'failed') status", "n created_at_ms", "if(n % 3 = 0, n + 1, null) finished_at_ms", "sha2(coalesce(text, ''), 256) input_digest")
    n = F.regexp_extract(F.decode("content", "utf-8"), r'"created_at_ms":([0-9]+)', 1).cast("long")
    root = _folder(spark, "tasks")
    files = exports.task_files(t).withColumns({
        "content": F.when(n % 5 == 0, F.encode(F.lit('{"task_id": '), "utf-8")).otherwise(F.col("content")), "path": F.when(n % 7 == 0, F.regexp_replace("path", "^.", "x")).otherwise(F.col("path")),
    })
    exports.write_files(files, root)
    return task_store.task_facts(spark, root).select("task_id", "status", "created_at_ms", "finished_at_ms", "input_digest")


WAV = """with t as (select conv_id as id, encode(string_agg(coalesce(text, ''), '' order by turn, coalesce(text, ''))) as data, encode('no audio' || cast(conv_id as varchar)) as other from conversations group by 1),
e as (select id, other, data || case when octet_length(data) % 2 = 1 then unhex('00') else unhex('') end as data from t), n as (select *, octet_length(data) as n from e),
f as (select id, n, data, case when id % 4 = 0 then other else unhex('52494646' || printf('%02x%02x%02x%02x', (n + 36) & 255, ((n + 36) >> 8) & 255, ((n + 36) >> 16) & 255, (n + 36) >> 24) || '57415645666d74201000000001000100e8030000d007000002001000' || '64617461' || printf('%02x%02x%02x%02x', n & 255, (n >> 8) & 255, (n >> 16) & 255, n >> 24)) || data end as content from n)"""


def _wavs(spark: SparkSession, sf: str) -> DataFrame:
    """All turns of a conversation as the samples of a WAV file, 1000 a second; every fourth is no audio."""
    size = lambda x: F.expr(f"unhex(format_string('%02x%02x%02x%02x', ({x}) & 255, shiftright({x}, 8) & 255, shiftright({x}, 16) & 255, shiftright({x}, 24)))")
    known = lambda x: F.unhex(F.lit(x))
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    c = v.table(spark, sf, "conversations").groupBy("conv_id").agg(F.encode(F.array_join(F.transform(turns, lambda x: x["text"]), ""), "utf-8").alias("data"))
    c = c.withColumn("data", F.when(F.octet_length("data") % 2 == 1, F.concat("data", known("00"))).otherwise(F.col("data"))).withColumn("n", F.octet_length("data"))
    wav = F.concat(known("52494646"), size("n + 36"), known("57415645666d74201000000001000100e8030000d00700000200100064617461"), size("n"), "data")
    content = F.when(F.col("conv_id") % 4 == 0, F.encode(F.concat(F.lit("no audio"), F.col("conv_id").cast("string")), "utf-8")).otherwise(wav)
    return c.select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit(".wav")).alias("path"), content.alias("content"))


def _written(spark: SparkSession, sf: str, name: str) -> tuple[str, DataFrame]:
    """The folder of the WAV files, and their conversations with each file's place."""
    root = _folder(spark, name)
    listed = exports.write_files(_wavs(spark, sf), root)
    return root, listed.select(F.regexp_extract("path", "([0-9]+)[.]wav", 1).cast("long").alias(KEY), F.concat(F.lit(f"{root}/"), "path").alias("path"))


@query(WAV + """ select id as recording_id, octet_length(content) as bytes, sha256(content) as sha256, case when id % 4 > 0 then 'pcm_s16le' end as codec, case when id % 4 > 0 then n // 2 end as duration_ms, case when id % 4 > 0 then 1000 end as rate, case when id % 4 > 0 then 1 end as channels,
case when id % 4 = 0 then 'AUDIO_PROBE_FAILED' when n // 2 < 400 then 'AUDIO_DURATION_LIMIT' end as error from f""")
def audio_probe(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _written(spark, sf, "audio")
    return audio.probed(spark, f"{root}/*.wav").select(_number("recording"), "bytes", "sha256", "codec", "duration_ms", "rate", "channels", "error")


@query(WAV + """, r as (select *, least(n // 2, (id * 7) % 300) as a, least(n // 2, (id * 7) % 300 + 50 + (id * 13) % 4000) as b from f)
select id as recording_id, case when id % 4 > 0 then 2 * (b - a) end as bytes, case when id % 4 > 0 then sha256(unhex(substr(hex(data), 4 * a + 1, 4 * (b - a)))) end as sha256, case when id % 4 = 0 then 'AUDIO_UNREADABLE' end as error from r""")
def audio_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Byte ranges of WAV files; what is no WAV spoils no other."""
    _, files = _written(spark, sf, "regions")
    wanted = files.select(KEY, "path", ((F.col(KEY) * 7) % 300).alias("start_ms"), ((F.col(KEY) * 7) % 300 + 50 + (F.col(KEY) * 13) % 4000).alias("end_ms"))
    return audio.regions(wanted, rate=1000).select(KEY, F.octet_length("pcm").alias("bytes"), F.sha2("pcm", 256).alias("sha256"), "error")


POWERS = WAV + """, h as (select id, n // 60 as frames, hex(data) as h from f where id % 4 > 0), w as (select id, unnest(range(0, frames)) as k, h from h), c as (select id, k, substr(h, 120 * k + 1, 120) as h from w),
p as (select id as recording_id, k as frame_no, k * 30 as start_ms, list_sum(list_transform(range(0, 30), lambda i: power(((cast('0x' || substr(h, 4 * i + 3, 2) || substr(h, 4 * i + 1, 2) as bigint) + 32768) % 65536) - 32768, 2))) / 30 as power from c)"""


@query(POWERS + " select * from p where start_ms >= 90")
def audio_powers(spark: SparkSession, sf: str) -> DataFrame:
    """Powers of frames by byte ranges; the filter reaches the bytes that are read."""
    root, _ = _written(spark, sf, "powers")
    rows = audio.power_frames(spark, f"{root}/*.wav", rate=1000, skip_unreadable=True).filter("start_ms >= 90")
    return rows.select(_number("recording"), "frame_no", "start_ms", "power")


@query(POWERS + """, levels as (select recording_id, case when power <= 0 then -120 else 20 * log10(sqrt(power) / 32768) end as db from p), k as (select *, db > -90 as kept, db >= -2.3 as speech from levels)
select recording_id, count(*) filter (kept) as n_kept, count(*) filter (kept and speech) as n_speech, round((count(*) filter (kept and speech)) / greatest(1, count(*) filter (kept)), 4) as speech_ratio,
round(coalesce(avg(db) filter (kept and speech), avg(db) filter (kept)), 2) as loudness_db, round(coalesce(stddev_pop(db) filter (kept and speech), stddev_pop(db) filter (kept), 0), 4) as loudness_std_db from k group by 1""")
def audio_loudness(spark: SparkSession, sf: str) -> DataFrame:
    """Loudness of whole recordings from their files' frames."""
    root, _ = _written(spark, sf, "loudness")
    rows = audio.power_frames(spark, f"{root}/*.wav", rate=1000, skip_unreadable=True).select(_number("recording").alias(KEY), "power")
    return timeline.loudness(rows, p=Timeline(speech_db=-2.3))


@query("""with t as (select doc_id, hex(encode(coalesce(text, ''))) as h, doc_id % 40 as a, doc_id % 40 + doc_id % 60 as b from documents), r as (select *, least(length(h) // 2, 32 * a) as x, least(length(h) // 2, 32 * b) as y from t)
select doc_id, y - x as bytes, sha256(substr(h, 2 * x + 1, 2 * (y - x))) as digest from r""")
def pcm_ranges(spark: SparkSession, sf: str) -> DataFrame:
    d = v.table(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("pcm"), (F.col("doc_id") % 40).alias("a"), (F.col("doc_id") % 40 + F.col("doc_id") % 60).alias("b"))
    d = d.select("doc_id", audio.pcm_range(F.col("pcm"), F.col("a"), F.col("b")).alias("part"))
    return d.select("doc_id", F.octet_length("part").cast("long").alias("bytes"), F.sha2(F.hex("part"), 256).alias("digest"))


@query("""with t as (select event_id, case event_id % 7 when 0 then 'mp3' when 1 then 'pcm_s24le' when 2 then 'alac' when 3 then 'amr_nb' when 4 then 'wmav2' when 5 then 'opus' end as codec, case event_id % 5 when 0 then 'mov,mp4,m4a,3gp' when 1 then 'asf' when 2 then 'wav' when 3 then 'avi,matroska' else 'aiff' end as containers from events)
select event_id, codec, containers, (codec in ('aac', 'amr_nb', 'amr_wb', 'flac', 'mp3', 'opus', 'vorbis') or starts_with(codec, 'pcm_')) and list_has_any(string_split(containers, ','), ['3g2', '3gp', 'aac', 'amr', 'flac', 'm4a', 'matroska', 'mj2', 'mov', 'mp3', 'mp4', 'ogg', 'wav', 'wave', 'webm']) as allowed from t""")
def media_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").selectExpr("event_id", "case event_id % 7 when 0 then 'mp3' when 1 then 'pcm_s24le' when 2 then 'alac' when 3 then 'amr_nb' when 4 then 'wmav2' when 5 then 'opus' end codec", "case event_id % 5 when 0 then 'mov,mp4,m4a,3gp' when 1 then 'asf' when 2 then 'wav' when 3 then 'avi,matroska' else 'aiff' end containers")
    return e.withColumn("allowed", documents.allowed(F.col("codec"), F.col("containers")))


@query(v.oracle("v_seg") + """ select recording_id, input_index % 2 as block, row_number() over (partition by recording_id, input_index % 2 order by input_index) - 1 as at, start_ms as begin_time, end_ms as end_time, text, speaker from v_seg""")
def asr_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """An answer's sentences of two channels."""
    sentence = F.struct("input_index", F.col("start_ms").alias("begin_time"), F.col("end_ms").alias("end_time"), "text", "speaker")
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("input_index") % 2 == k, sentence)))
    answers = v.segments(spark, sf).groupBy(KEY).agg(*[of(k).alias(f"s{k}") for k in (0, 1)])
    body = F.to_json(F.struct(F.array(*[F.struct(F.lit(k).alias("channel_id"), F.col(f"s{k}").alias("sentence_list")) for k in (0, 1)]).alias("flash_result")))
    rows = documents.flattened_flash(answers.select(KEY, body.alias("body")))
    return rows.select(KEY, F.col("pos.block").cast("long").alias("block"), F.col("pos.at").cast("long").alias("at"), "begin_time", "end_time", "text", "speaker")


@query(v.oracle("v_seg") + """, r as (select recording_id, input_index, text, case when input_index % 7 = 6 then 0 else start_ms end as start_ms, case when input_index % 4 <> 1 then end_ms when input_index % 3 = 0 then end_ms + 5 end as e, case when input_index % 5 > 1 then 'x' || cast(input_index as varchar) end as given from v_seg)
select recording_id, coalesce(given, 'asr-' || cast(row_number() over (partition by recording_id order by input_index) as varchar)) as id, start_ms, coalesce(e, start_ms) as end_ms, text, case when coalesce(e, start_ms) <= start_ms then 'ASR_RESULT_INVALID' end as violation from r""")
def asr_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Times under either name or none, ids that are missing or empty."""
    rows = v.segments(spark, sf).selectExpr(
        "recording_id", "input_index pos", "text", "case when input_index % 7 <> 6 and input_index % 3 <> 0 then start_ms end begin_time", "case when input_index % 7 <> 6 then start_ms end start_time", "case when input_index % 4 <> 1 then end_ms end time",
        "case when input_index % 3 = 0 then end_ms + 5 end end_time", "case when input_index % 5 = 0 then null when input_index % 5 = 1 then '' else concat('x', input_index) end id",
    )
    return documents.normalised_asr(rows)


@query(v.oracle("v_seg") + " select recording_id, input_index, row_number() over (partition by recording_id order by start_ms, input_index) as ordinal from v_seg")
def segment_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return windows.ordinals(v.segments(spark, sf)).select(KEY, "input_index", F.col("ordinal").cast("long").alias("ordinal"))


@query("select event_id, round(case when event_id % 9 = 0 or value is null or value <= 0 then -120.0e0 else 20 * log10(sqrt(value * 1000) / 32768) end, 6) as db from events")
def rms_levels(spark: SparkSession, sf: str) -> DataFrame:
    power = F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.col("value") * 1000)
    return v.table(spark, sf, "events").select("event_id", F.round(vx.rms_db(power), 6).alias("db"))


@query("""with t as (select doc_id, md5(coalesce(text, '')) as h from documents) select doc_id, list_sum(list_transform(range(8), lambda i: (i + 1) * (((cast('0x' || substr(h, 4 * i + 3, 2) || substr(h, 4 * i + 1, 2) as bigint) + 32768) % 65536) - 32768) / 32768.0e0)) as weighed from t""")
def int16_floats(spark: SparkSession, sf: str) -> DataFrame:
    samples = vx.int16_samples(F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    return v.table(spark, sf, "documents").select("doc_id", vx.total(F.transform(samples, lambda x, i: x * (i + 1))).alias("weighed"))


@query("select doc_id, doc_id % 4 = 0 as legal from documents")
def task_ids(spark: SparkSession, sf: str) -> DataFrame:
    h = F.md5(F.coalesce("text", F.lit("")))
    name = F.when(F.col("doc_id") % 4 == 0, h).when(F.col("doc_id") % 4 == 1, F.substring(h, 1, 31)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("../"), h))
    return v.table(spark, sf, "documents").select("doc_id", tx.is_task_id(name).alias("legal"))


# --- streams -----------------------------------------------------------------------------------------------------

SESSIONS = """with e as (select user_id, value, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts) as old from events),
s as (select *, sum(case when us - old < 1800000000 then 0 else 1 end) over (partition by user_id order by us rows unbounded preceding) as k from e)
select user_id, min(us) // 1000 as start_ms, (max(us) + 1800000000) // 1000 as end_ms, count(*) as n_events, round(sum(value), 4) as total from s group by user_id, k"""


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream; the pattern names a file as well as a folder."""
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/{name}.parque[t]")


@query(SESSIONS)
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.event_sessions(v.table(spark, sf, "events"))


@query(SESSIONS)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    stream = _stream(spark, sf, "events")
    return sessions.drained(sessions.event_sessions(stream), spark, "complete", "stream_sessions")


@query("select event_type, epoch_ms(time_bucket(interval '1 hour', ts)) as start_ms, count(*) as n_events from events group by 1, 2")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    stream = _stream(spark, sf, "events")
    return sessions.drained(sessions.event_windows(stream, "1 hour"), spark, "complete", "stream_tumbling")


@query("with w as (select event_type, unnest([epoch_ms(time_bucket(interval '30 minutes', ts)), epoch_ms(time_bucket(interval '30 minutes', ts)) - 1800000]) as start_ms from events) select event_type, start_ms, count(*) as n_events from w group by 1, 2")
def event_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.event_windows(v.table(spark, sf, "events"), "1 hour", "30 minutes")


def _task_events(rows: DataFrame) -> DataFrame:
    name = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "click", "started").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").otherwise(F.when(F.col("event_id") % 3 == 0, "cancel_requested").otherwise("expired"))
    return rows.select(F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 50).cast("string")).alias("task_id"), name.alias("event"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("seq"))


@query()
def task_state_batch(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.task_states_batch(_task_events(v.table(spark, sf, "events")))


@query()
def stream_task_state(spark: SparkSession, sf: str) -> DataFrame:
    stream = _stream(spark, sf, "events")
    return sessions.drained(sessions.task_states(_task_events(stream)), spark, "update", "stream_task_state", ("task_id",))


__all__ = ["oracle_sql", "queries", "task_queries", "timeline_queries"]
