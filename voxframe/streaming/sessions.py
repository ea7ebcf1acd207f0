"""Sessions, sliding windows and task states as Structured Streaming, each with the same answer as its batch form."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from voxframe.operators.intervals import KEY
from voxframe.operators.timelines import Blocks
from voxframe.params import Tasks
from voxframe.shared import scratch


def session_candidates(segments: DataFrame, gap_ms: int = 500) -> DataFrame:
    """Candidate regions as sessions: a session lasts from a segment's start to its end plus the gap.

    Sessions that touch are one, so the gap's last millisecond is not part of it: exactly gap_ms apart still merges.
    """
    at = F.timestamp_millis(F.col("start_ms"))
    length = F.concat((F.col("end_ms") - F.col("start_ms") + gap_ms + 1).cast("string"), F.lit(" milliseconds"))
    rows = segments.groupBy(KEY, F.session_window(at, length).alias("w")).agg(F.count(F.lit(1)).alias("segment_count"), F.max("end_ms").alias("end_ms"))
    return rows.select(KEY, F.unix_millis("w.start").alias("start_ms"), "end_ms", "segment_count")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each user's events; with `late`, a watermark that closes them in a stream."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")).select("user_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n_events", F.round("total", 4).alias("total"))


def event_windows(events: DataFrame, length: str, hop: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling or sliding windows over all events by type."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("event_type", F.window("at", length, hop).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select("event_type", F.unix_millis("w.start").alias("start_ms"), "n_events")


def drained(stream: DataFrame, spark: SparkSession, mode: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """All that a stream gives for what its source holds now, as Parquet in the shared folder, which keeps its checkpoint too.

    In complete mode the last micro-batch is the answer; in update mode the last row of each key is. A micro-batch that
    is run again replaces its own files.
    """
    path = scratch(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/n={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    if query.lastProgress is None:  # the source holds nothing
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(schema).parquet(f"{path}/out" if mode == "complete" else f"{path}/out/n=*")
    if keys:
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("last")).select("last.*")
    return rows.select(*stream.columns)


#: What happens to tasks; a terminal state never changes, and a cancel request beats success.
EVENTS = ("created", "started", "cancel_requested", "succeeded", "failed", "expired")
STATE = "task_id string, status string, created_at_ms long, finished_at_ms long, cancel_requested boolean, n_events int"
CHANGED = Row(*[c.split()[0] for c in STATE.split(", ")])
NAMES = CHANGED[1:]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def next_state(state: dict[str, Any] | None, event: str, at_ms: int, p: Tasks = Tasks()) -> dict[str, Any]:
    """A task's state after an event."""
    s = dict(state) if state else {"status": "queued", "created_at_ms": at_ms, "finished_at_ms": None, "cancel_requested": False, "n_events": 0}
    s["n_events"] += 1
    s["created_at_ms"] = min(s["created_at_ms"], at_ms)
    done = s["status"] in p.terminal
    if event == "expired" and done and at_ms - s["finished_at_ms"] >= p.retention_ms:
        s["status"] = "expired"
    elif done or s["status"] == "expired":
        pass
    elif event == "cancel_requested":
        s["cancel_requested"] = True
        if s["status"] == "queued":
            s |= {"status": "cancelled", "finished_at_ms": at_ms}
    elif event == "started":
        s["status"] = "running"
    elif event in ("succeeded", "failed"):
        s |= {"status": "cancelled" if s["cancel_requested"] else event, "finished_at_ms": at_ms}
    return s


class States(StatefulProcessor):
    """Keeps a task's state; rows of a micro-batch are applied in order of time and seq."""

    def __init__(self, p: Tasks):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", ", ".join(STATE.split(", ")[1:]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        kept = self.kept.get()
        now = dict(zip(NAMES, kept, strict=True)) if kept is not None else None
        for at, _, event in sorted(((r["at_ms"], r["seq"], r["event"]) for r in rows), key=lambda r: r[:2]):
            now = next_state(now, event, at, self.p)
        state = tuple(now[n] for n in NAMES)
        self.kept.update(state)
        yield CHANGED(key[0], *state)

    def close(self) -> None:
        pass


def task_states(events: DataFrame, p: Tasks = Tasks()) -> DataFrame:
    """State of each task in a stream of (task_id, event, at_ms, seq): updates by micro-batch, state kept per task in RocksDB.

    Within a batch events are taken in order of time and seq.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.select("task_id", "event", F.col("at_ms").cast("long").alias("at_ms"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("task_id").transformWithState(States(p), STATE, "update", "None")


def task_states_batch(events: DataFrame, p: Tasks = Tasks()) -> DataFrame:
    """The same from a table, as a fold over each task's events."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit("queued").alias("status"), none.alias("created_at_ms"), none.alias("finished_at_ms"), F.lit(False).alias("cancel_requested"), F.lit(0).alias("n_events"))

    def step(a: Column, x: Column) -> Column:
        done = a["status"].isin(*p.terminal)
        active = ~done & (a["status"] != "expired")
        ends = x["event"].isin("succeeded", "failed")
        status = (
            F.when((x["event"] == "expired") & done & (x["at_ms"] - a["finished_at_ms"] >= p.retention_ms), "expired").when(~active, a["status"])
            .when((x["event"] == "cancel_requested") & (a["status"] == "queued"), "cancelled").when(x["event"] == "started", "running")
            .when(ends & a["cancel_requested"], "cancelled").when(ends, x["event"]).otherwise(a["status"])
        )
        return F.struct(
            status.alias("status"), F.least(a["created_at_ms"], x["at_ms"]).alias("created_at_ms"), F.when(active & status.isin(*p.terminal), x["at_ms"]).otherwise(a["finished_at_ms"]).alias("finished_at_ms"),
            (a["cancel_requested"] | (active & (x["event"] == "cancel_requested"))).alias("cancel_requested"), (a["n_events"] + 1).alias("n_events"),
        )

    ordered = F.array_sort(F.collect_list(F.struct(F.col("at_ms").cast("long").alias("at_ms"), F.col("seq").cast("long").alias("seq"), "event")))
    return events.groupBy("task_id").agg(F.aggregate(ordered, start, step).alias("s")).select("task_id", "s.*")


def ttl_actions(tasks: DataFrame, now_ms: int, p: Tasks = Tasks()) -> DataFrame:
    """What a clean-up does: finished tasks expire p.retention_ms after their end, or else their last change; expired ones are
    deleted p.expired_metadata_ms after they expired. A time that is absent, null or 0 is the present."""
    age = lambda *names: now_ms - F.coalesce(*[F.nullif(c, F.lit(0)) for c in names if c in tasks.columns], F.lit(now_ms))
    ended = F.col("status").isin(*p.terminal) & (age("finished_at_ms", "updated_at_ms") >= p.retention_ms)
    action = F.when(ended, "expire").when((F.col("status") == "expired") & (age("expired_at_ms") >= p.expired_metadata_ms), "delete").otherwise("keep")
    return tasks.withColumn("action", action)


def recovery(tasks: DataFrame) -> DataFrame:
    """What a restart does with unfinished tasks."""
    open_ = F.col("status").isin("queued", "running")
    action = F.when(~open_, "none").when(F.col("cancel_requested_at_ms").isNotNull(), "cancel").when(F.col("input_mode") == "cloud_asr", "fail:CREDENTIAL_LOST").otherwise("rerun")
    return tasks.withColumn("action", action)


def idempotent(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Adds outcome and found_task to requests (idempotency_key, input_digest): the first task of the key that isn't expired is
    replayed if its input is the same and conflicts if not; without such a task, or without a key, one is created.

    tasks: task_id, idempotency_key, input_digest, status, created_at_ms. Requests without a key take no part in the join.
    """
    order = F.struct("created_at_ms", "task_id")
    known = tasks.filter("idempotency_key is not null and status <> 'expired'").groupBy("idempotency_key").agg(F.min_by(F.struct("task_id", F.col("input_digest").alias("digest")), order).alias("known"))
    rows = requests.filter("idempotency_key is not null").join(known, "idempotency_key", "left")
    outcome = F.when(F.col("known").isNull(), "created").when(F.col("known.digest") == F.col("input_digest"), "replayed").otherwise("conflict")
    rows = rows.select(*requests.columns, outcome.alias("outcome"), F.col("known.task_id").alias("found_task"))
    new = requests.filter("idempotency_key is null").select("*", F.lit("created").alias("outcome"), F.lit(None).cast("string").alias("found_task"))
    return rows.unionByName(new)


#: Fixed value: the schema of a task's facts.
TASK_SCHEMA = "voice_analysis_task_v1"


def cleaned(tasks: DataFrame, now_ms: int, p: Tasks = Tasks()) -> DataFrame:
    """The task facts that a clean-up leaves: deleted ones are gone, those that expire keep their id and times only."""
    rows = ttl_actions(tasks, now_ms, p).filter("action <> 'delete'")
    expire, kept = F.col("action") == "expire", ("task_id", "created_at_ms")
    fields = [F.col(f"`{c}`") if c in kept else F.when(~expire, F.col(f"`{c}`")).alias(c) for c in tasks.columns if c not in ("status", "updated_at_ms", "expired_at_ms")]
    stamp = lambda c: F.when(expire, F.lit(now_ms)).otherwise(F.col(c) if c in tasks.columns else F.lit(None).cast("long")).alias(c)
    return rows.select(*fields, F.when(expire, "expired").otherwise(F.col("status")).alias("status"), stamp("updated_at_ms"), stamp("expired_at_ms"))


def occupancy(tasks: DataFrame, slots: int = 1) -> DataFrame:
    """One row: tasks retained (not expired), failed, running or queued, and whether a slot is free."""
    active = F.count_if(F.col("status").isin("queued", "running"))
    return tasks.agg(F.count_if(F.col("status") != "expired").alias("retained"), F.count_if(F.col("status") == "failed").alias("failed"), active.alias("active"), (active < slots).alias("accepts"))


def recovery_order(tasks: DataFrame) -> DataFrame:
    """The tasks that a restart runs again, one after the other: back in the queue, oldest first; turn counts them, block by
    block, so that no task of Spark's has them all."""
    by, order = Blocks(), ("created_at_ms", "task_id")
    again = by.deal(recovery(tasks).filter("action = 'rerun'").drop("action"), order, ())
    return by.running(again, "turn", F.lit(1), "sum", order, ()).withColumn("status", F.lit("queued")).drop("_block")
