"""Queries of tasks' lives, as streams and as tables, and their SQL.

A conversation is a task: its turns are events, hours apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.params import Tasks
from voxframe.plans import views as v
from voxframe.plans.registry import query
from voxframe.shared import scratch
from voxframe.sources import task_store
from voxframe.streaming import sessions, tasks

HOUR = 3_600_000
#: Past all events of the tables.
NOW = 100_000 * HOUR
LIVES = Tasks(retention_ms=70_000 * HOUR, expired_metadata_ms=20_000 * HOUR)

EVENTS = """with e as (select md5(cast(conv_id as varchar)) as task_id, conv_id * 1000 + turn as seq, ((conv_id * 7919) % 40000 + turn * 2 + 1) * 3600000 as at_ms,
  case when turn = 0 and conv_id % 19 > 0 then 'created' when conv_id % 11 = turn then 'cancel_requested' when turn % 5 = 1 then 'started' when turn % 5 = 3 and conv_id % 3 = 0 then 'failed' when turn % 5 = 3 and conv_id % 3 = 1 then 'succeeded' when turn % 5 = 4 then 'created' else 'progress' end as event from conversations)"""

LIFE = EVENTS + """, b as (select task_id, min((at_ms, seq)) as born from e where event = 'created' group by 1),
t as (select e.task_id, b.born[1] as created_at_ms, min((at_ms, seq)) filter (event = 'started') as s, min((at_ms, seq)) filter (event = 'cancel_requested') as c, min((at_ms, seq)) filter (event in ('succeeded', 'failed')) as f,
  arg_min(event, (at_ms, seq)) filter (event in ('succeeded', 'failed')) as how from e join b on e.task_id = b.task_id and (at_ms, seq) >= b.born group by 1, 2),
u as (select *, c is not null and (s is null or c < s) and (f is null or c < f) as dropped from t),
w as (select task_id, created_at_ms, case when dropped then c[1] else f[1] end as ended, case when dropped then 'cancelled' when f is not null then case when c < f then 'cancelled' else how end when s is not null then 'running' else 'queued' end as last from u),
x as (select *, case when ended + 252000000000 <= 360000000000 then ended + 252000000000 end as expired_at_ms from w)
select task_id, case when expired_at_ms + 72000000000 <= 360000000000 then 'deleted' when expired_at_ms is not null then 'expired' else last end as status, created_at_ms, case when expired_at_ms is null then ended end as finished_at_ms, expired_at_ms from x"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    name = """case when turn = 0 and conv_id % 19 > 0 then 'created' when conv_id % 11 = turn then 'cancel_requested' when turn % 5 = 1 then 'started' when turn % 5 = 3 and conv_id % 3 = 0 then 'failed'
      when turn % 5 = 3 and conv_id % 3 = 1 then 'succeeded' when turn % 5 = 4 then 'created' else 'progress' end event"""
    return v.table(spark, sf, "conversations").selectExpr("md5(cast(conv_id as string)) task_id", name, f"((conv_id * 7919) % 40000 + turn * 2 + 1) * {HOUR} at_ms", "conv_id * 1000 + turn seq")


def _arriving(spark: SparkSession, rows: DataFrame, name: str, late_ms: int, slices: int = 3) -> DataFrame:
    """rows (event, at_ms and more) as a stream of files that arrive by time, slices of them, each not longer than late_ms; in the
    end a clock that has moved on to NOW."""
    root = scratch(spark, name)
    for k in range(slices):
        part = F.col("at_ms") >= k * late_ms if k == slices - 1 else F.col("at_ms").between(k * late_ms, (k + 1) * late_ms - 1)
        rows.filter(part).write.mode("append").parquet(root)
    clock = {"event": F.lit(tasks.CLOCK), "at_ms": F.lit(NOW + late_ms).cast("long")}
    spark.range(1).select(*[clock.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]).write.mode("append").parquet(root)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 16).parquet(root)


@query(LIFE)
def task_life(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.life_at(_events(spark, sf), NOW, LIVES)


@query(LIFE)
def stream_task_life(spark: SparkSession, sf: str) -> DataFrame:
    """Three slices of time arrive one after the other; timers expire and delete tasks that have no further event."""
    late = 15_000 * HOUR
    changes = tasks.task_life(_arriving(spark, _events(spark, sf), "life-in", late), f"{late} milliseconds", LIVES)
    log = sessions.drained(changes, spark, "update", "stream_task_life")
    last = log.groupBy("task_id").agg(F.max_by(F.struct("status", "created_at_ms", "finished_at_ms", "expired_at_ms"), "version").alias("s"))
    return last.select("task_id", "s.*")


REQUESTS = """with r as (select conv_id * 1000 + turn as seq, case when conv_id % 9 > 0 then 'key-' || cast(conv_id as varchar) end as k, ((conv_id * 7919) % 40000 + turn * 2 + 1) * 3600000 as at_ms, cast((turn + conv_id) % 2 as varchar) as digest, 'new-' || cast(conv_id * 1000 + turn as varchar) as task from conversations),
o as (select 'old-' || cast(conv_id as varchar) || '-' || cast(n as varchar) as task, 'key-' || cast(conv_id as varchar) as k, n as created_at_ms, cast(n % 2 as varchar) as digest, ((conv_id * 7919) % 40000 + n * 3) * 3600000 + 1 as until from (select conv_id, n from conversations, unnest([1, 2]) as x(n) where turn = 0 and conv_id % 2 = 0)),
m as (select r.*, (select arg_min({'task': o.task, 'digest': o.digest}, (o.created_at_ms, o.task)) from o where o.k = r.k and o.until > r.at_ms) as old from r),
f as (select *, first_value({'task': task, 'digest': digest, 'seq': seq}) over (partition by k, old is null order by at_ms, seq) as first from m)
select seq as request_id, case when k is null then 'created' when old is not null then case when old.digest = digest then 'replayed' else 'conflict' end when first.seq = seq then 'created' when first.digest = digest then 'replayed' else 'conflict' end as outcome,
  case when k is null then null when old is not null then old.task when first.seq <> seq then first.task end as found_task from f"""


@query(REQUESTS)
def stream_idempotent_creation(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn asks for a task; half of the keys have two tasks from before, which expire on the way."""
    c = v.table(spark, sf, "conversations")
    asked = c.selectExpr("if(conv_id % 9 > 0, concat('key-', conv_id), null) idempotency_key", "'requested' event", f"((conv_id * 7919) % 40000 + turn * 2 + 1) * {HOUR} at_ms", "conv_id * 1000 + turn seq", "concat('new-', conv_id * 1000 + turn) task_id", "cast((turn + conv_id) % 2 as string) input_digest")
    old = c.filter("turn = 0 and conv_id % 2 = 0").select("conv_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    old = old.selectExpr("concat('old-', conv_id, '-', n) task_id", "concat('key-', conv_id) idempotency_key", "cast(n % 2 as string) input_digest", "'running' status", "cast(n as bigint) created_at_ms", f"((conv_id * 7919) % 40000 + n * 3) * {HOUR} + 1 until")
    gone = old.selectExpr("idempotency_key", "'expired' event", "until at_ms", "cast(null as bigint) seq", "task_id", "cast(null as string) input_digest")
    late = 15_000 * HOUR
    stream = _arriving(spark, asked.unionByName(gone), "requests", late)
    answers = tasks.idempotent_creation(stream, f"{late} milliseconds", old.drop("until"))
    return sessions.drained(answers, spark, "update", "stream_idempotent_creation").drop("at_ms")


@query("""with t as (select md5(cast(conv_id as varchar)) as task_id, conv_id, turn + 1 as updated_at_ms, 'turn-' || cast(turn as varchar) as stage, sha256(coalesce(text, '')) as input_digest from conversations),
l as (select task_id, conv_id, arg_max({'u': updated_at_ms, 's': stage, 'd': input_digest}, updated_at_ms) as f from t group by 1, 2)
select task_id, f.u as updated_at_ms, f.s as stage, f.d as input_digest from l where (conv_id + f.u) % 6 > 0""")
def stream_task_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn changes its conversation's fact, from a stream through the sink; some are deleted at their last turn. What is
    left comes back through the source."""
    c = v.table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = c.join(last, "conv_id").selectExpr("md5(cast(conv_id as string)) task_id", "if(turn = last and (conv_id + turn + 1) % 6 = 0, 'deleted', 'running') status", "concat('turn-', turn) stage", "turn + 1 updated_at_ms", "sha2(coalesce(text, ''), 256) input_digest")
    root = scratch(spark, "facts")
    for part in ("updated_at_ms <= 2", "updated_at_ms > 2"):
        rows.filter(part).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 16).parquet(f"{root}/in")
    task_store.kept_facts(stream, f"{root}/tasks", f"{root}/checkpoint").awaitTermination()
    facts = task_store.changed_facts(spark, f"{root}/tasks", settle_ms=0)
    return sessions.drained(facts, spark, "append", "stream_task_facts").select("task_id", "updated_at_ms", "stage", "input_digest")
