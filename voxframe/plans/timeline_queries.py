"""Queries of one long timeline, by blocks, and their SQL: all conversations are one recording, laid over each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.operators import intervals, packing, timeline, windows
from voxframe.operators.intervals import KEY
from voxframe.operators.timelines import Blocks
from voxframe.plans import views as v
from voxframe.plans.registry import query

ONE = v.oracle("v_seg") + """, one as (select 7 as recording_id, recording_id * 1000 + input_index as input_index, start_ms + recording_id * 40000 as start_ms, end_ms + recording_id * 40000 as end_ms, text, speaker, dur_ms, recording_id as conv from v_seg)"""


def _one(spark: SparkSession, sf: str) -> DataFrame:
    shift = F.col(KEY) * 40_000
    return v.segments(spark, sf).select(F.lit(7).cast("long").alias(KEY), (F.col(KEY) * 1000 + F.col("input_index")).alias("input_index"), (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"), "text", "speaker", "dur_ms", "confidence", F.col(KEY).alias("conv"))


@query(ONE + """, m as (select *, max(end_ms) over (order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as m from one),
i as (select *, sum(case when start_ms > m then 1 else 0 end) over (order by start_ms, end_ms rows unbounded preceding) as island from m)
select recording_id, min(start_ms) as start_ms, max(end_ms) as end_ms from i group by recording_id, island""")
def long_interval_union(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.union(_one(spark, sf), by=Blocks()).select(KEY, "start_ms", "end_ms")


@query(ONE + """, reach as (select *, max(end_ms) over (order by start_ms, input_index rows between unbounded preceding and 1 preceding) as m from one),
isl as (select *, sum(case when start_ms - m > 500 then 1 else 0 end) over (order by start_ms, input_index rows unbounded preceding) as island from reach),
gaps as (select *, greatest(0, start_ms - max(end_ms) over (partition by island order by start_ms, input_index rows between unbounded preceding and 1 preceding)) as gap from isl)
select min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as segment_count, cast(coalesce(max(gap), 0) as bigint) as max_internal_gap_ms, cast(coalesce(sum(length(text)), 0) as bigint) as text_chars from gaps group by island""")
def long_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return windows.candidates(_one(spark, sf), by=Blocks()).select("start_ms", "end_ms", "segment_count", "max_internal_gap_ms", F.col("text_chars").cast("long").alias("text_chars"))


FRAMES = v.oracle("v_seg") + """, f as (select 7 as recording_id, recording_id * 1000 + input_index as n, (recording_id * 1000 + input_index) * 700 as start_ms, (recording_id * 1000 + input_index) * 700 + 400 + (dur_ms % 5) * 75 as end_ms, case when dur_ms % 100 = 0 then 0 when dur_ms % 7 = 0 then 2 else 1 end as active, case when dur_ms % 100 = 0 then '' else speaker end as dom from v_seg),
ov as (select recording_id, start_ms - 200 as start_ms, end_ms + 200 as end_ms from f where active >= 2), st as (select *, sum(case when active >= 2 then 1 else 0 end) over (order by start_ms) as stretch, from f),
si as (select *, sum(case when active = 0 then end_ms - start_ms else 0 end) over (partition by stretch order by start_ms) as silence from st),
la as (select *, lag(dom) over w as old, lag(end_ms) over w as old_end, lag(silence) over w as old_silence from si where active = 1 window w as (partition by stretch order by start_ms)),
bl as (select start_ms, end_ms from ov union all select greatest(old_end, start_ms) - 200, greatest(old_end, start_ms) + 200 from la where old <> '' and dom <> '' and old <> dom and silence - old_silence <= 500),
cl as (select f.*, case when active >= 2 or exists (select 1 from bl b where b.start_ms < f.end_ms and b.end_ms > f.start_ms) then 1 else 0 end as closer from f),
cs as (select *, sum(closer) over (order by start_ms) as part from cl), cq as (select *, max(case when active = 0 then end_ms end) over (partition by part order by start_ms rows between unbounded preceding and 1 preceding) as silent_to from cs where closer = 0),
cn as (select *, lag(end_ms) over (partition by part order by start_ms) as last from cq where active = 1),
cr as (select *, sum(case when last is null or greatest(start_ms, coalesce(silent_to, 0)) - last > 500 then 1 else 0 end) over (partition by part order by start_ms) as run from cn)
select recording_id, min(start_ms) as start_ms, max(end_ms) as end_ms from cr group by recording_id, part, run"""


@query(FRAMES)
def long_speaker_runs(spark: SparkSession, sf: str) -> DataFrame:
    s = v.segments(spark, sf)
    start = (F.col(KEY) * 1000 + F.col("input_index")) * 700
    active = F.when(F.col("dur_ms") % 100 == 0, 0).when(F.col("dur_ms") % 7 == 0, 2).otherwise(1)
    f = s.select(F.lit(7).cast("long").alias(KEY), start.alias("start_ms"), (start + 400 + F.col("dur_ms") % 5 * 75).alias("end_ms"), active.alias("active"), F.when(F.col("dur_ms") % 100 == 0, "").otherwise(F.col("speaker")).alias("dom"))
    return timeline.single_speaker_runs(f, by=Blocks())


@query(ONE.replace("with ", "with recursive ", 1) + """, p as (select input_index as place, row_number() over (order by input_index) as n, dur_ms * 3 as ms, dur_ms * 1000 as sz from one),
b as (select place, n, 0 as batch, 1 as k, ms, sz from p where n = 1
 union all select p.place, p.n, case when b.k >= 16 or b.ms + p.ms > 60000 or b.sz + p.sz > 33554432 then b.batch + 1 else b.batch end, case when b.k >= 16 or b.ms + p.ms > 60000 or b.sz + p.sz > 33554432 then 1 else b.k + 1 end,
 case when b.k >= 16 or b.ms + p.ms > 60000 or b.sz + p.sz > 33554432 then p.ms else b.ms + p.ms end, case when b.k >= 16 or b.ms + p.ms > 60000 or b.sz + p.sz > 33554432 then p.sz else b.sz + p.sz end from b join p on p.n = b.n + 1)
select 7 as recording_id, place, batch from b""")
def long_batch_packing(spark: SparkSession, sf: str) -> DataFrame:
    rows = _one(spark, sf).select(KEY, F.col("input_index").alias("place"), (F.col("dur_ms") * 3).alias("duration_ms"), (F.col("dur_ms") * 1000).alias("n_bytes"))
    return packing.batches_in_blocks(rows)


@query(ONE + """, l as (select conv, min(start_ms) as start_ms, max(end_ms) as end_ms from one group by 1)
select l.conv, s.input_index, least(s.end_ms, l.end_ms) - greatest(s.start_ms, l.start_ms) as overlap_ms from one s join l on l.start_ms < s.end_ms and l.end_ms > s.start_ms""")
def scaled_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """Whole conversations against single turns of all of them, on one timeline."""
    s = _one(spark, sf)
    whole = s.groupBy(KEY, "conv").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    pairs = intervals.scaled_join(s.select(KEY, "input_index", "start_ms", "end_ms"), whole)
    return pairs.select("conv", "input_index", intervals.overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("right_start_ms"), F.col("right_end_ms")).alias("overlap_ms"))
