"""The life of tasks as streams: states with expiry by timer, and creation that answers a repeated request alike.

Rows of a key wait in its state until the watermark has passed them, and are then applied in order of time and seq. So
answers don't depend on how the input is cut into micro-batches, as long as no row is later than the watermark allows
(Spark drops such rows and counts them). What is due after an event (expiry, deletion) is a timer of the key: it needs
no further event of it, only time that moves on, be it by other keys' rows or by rows of event `clock`, which belong to no
key. State lives in RocksDB, by key, and survives restarts in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxframe.params import Tasks

CLOCK = "clock"
EVENTS = ("created", "started", "cancel_requested", "succeeded", "failed")
LIFE = "task_id string, status string, at_ms long, created_at_ms long, finished_at_ms long, expired_at_ms long, version int"
ANSWERS = "request_id long, outcome string, found_task string, at_ms long"
CHANGE, ANSWER = (Row(*[c.split()[0] for c in kind.split(", ")]) for kind in (LIFE, ANSWERS))
#: Groups of requests without a key.
KEYLESS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Applies each key's rows in order of (at_ms, seq) once the watermark has passed them. Subclasses say what is kept for a key
    (None: nothing), how a row changes it, and what falls due by itself."""

    #: Columns of a row besides the key, (at_ms, seq) first.
    waits = "at_ms long, seq long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.waits.split(", ")]
        self.waiting = handle.getListState("waiting", self.waits)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(r[n] for n in self.names) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])  # none if there is no list
        before = self.load()
        kept, out = before, []
        for row in (r for r in held if r[0] <= now):
            kept = self._pass(key[0], kept, row[0], out)
            kept = self.apply(key[0], kept, row, out)
        kept = self._pass(key[0], kept, now + 1, out)
        later = [r for r in held if r[0] > now]
        if not later and held:
            self.waiting.clear()
        elif len(later) < len(held):
            self.waiting.put(later)
        if kept != before:
            self.save(before, kept)
        nexts = {*[r[0] for r in later[:1]], self.due(kept) if kept else None}
        for at in nexts - {None}:
            self.handle.registerTimer(at)
        return iter(out)

    def _pass(self, key: str, kept: Any, until: int, out: list[Row]) -> Any:
        """Whatever falls due before that time."""
        while kept is not None and (at := self.due(kept)) is not None and at < until:
            kept = self.expire(key, kept, at, out)
        return kept

    def load(self) -> Any:
        raise NotImplementedError

    def save(self, before: Any, kept: Any) -> None:
        raise NotImplementedError

    def apply(self, key: str, kept: Any, row: tuple, out: list[Row]) -> Any:
        raise NotImplementedError

    def due(self, kept: Any) -> int | None:
        return None

    def expire(self, key: str, kept: Any, at: int, out: list[Row]) -> Any:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Life(InOrder):
    """Keeps a value: status, times, whether cancelling was asked for, number of changes so far."""

    waits = "at_ms long, seq long, event string"
    keeps = "status string, created_at_ms long, finished_at_ms long, expired_at_ms long, cancel boolean, version int"

    def __init__(self, p: Tasks):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", self.keeps)

    def load(self) -> tuple | None:
        kept = self.kept.get()
        return tuple(kept) if kept is not None else None

    def save(self, before: tuple | None, kept: tuple | None) -> None:
        self.kept.clear() if kept is None else self.kept.update(kept)

    def _changed(self, key: str, at: int, kept: tuple, out: list[Row], **new: Any) -> tuple:
        names = [c.split()[0] for c in self.keeps.split(", ")]
        s = dict(zip(names, kept, strict=True)) | new
        if s["status"] != kept[0]:
            s["version"] += 1
            out.append(CHANGE(key, s["status"], at, s["created_at_ms"], s["finished_at_ms"], s["expired_at_ms"], s["version"]))
        return tuple(s[n] for n in names)

    def due(self, kept: tuple) -> int | None:
        if kept[0] == "expired":
            return kept[3] + self.p.expired_metadata_ms
        return kept[2] + self.p.retention_ms if kept[0] in self.p.terminal else None

    def expire(self, key: str, kept: tuple, at: int, out: list[Row]) -> tuple | None:
        if kept[0] == "expired":
            self._changed(key, at, kept, out, status="deleted")
            return None
        return self._changed(key, at, kept, out, status="expired", finished_at_ms=None, expired_at_ms=at, cancel=False)

    def apply(self, key: str, kept: tuple | None, row: tuple, out: list[Row]) -> tuple | None:
        at, _, event = row
        if kept is None:
            return self._changed(key, at, (None, at, None, None, False, 0), out, status="queued") if event == "created" else None
        if kept[0] not in ("queued", "running"):
            return kept
        if event == "cancel_requested":
            return self._changed(key, at, kept, out, cancel=True, **({"status": "cancelled", "finished_at_ms": at} if kept[0] == "queued" else {}))
        if event == "started":
            return self._changed(key, at, kept, out, status="running")
        if event in ("succeeded", "failed"):
            return self._changed(key, at, kept, out, status="cancelled" if kept[4] else event, finished_at_ms=at)
        return kept


class FirstWriter(InOrder):
    """Keeps a map of a key's live tasks: task_id to (created_at_ms, input_digest)."""

    waits = "at_ms long, seq long, event string, task_id string, input_digest string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.live = handle.getMapState("live", "task_id string", "created_at_ms long, input_digest string")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: Any) -> None:
        self.live.updateValue((initialState["task_id"],), (initialState["created_at_ms"], initialState["input_digest"]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if key[0][0] == "k":
            return super().handleInputRows(key, rows, timerValues)
        return (ANSWER(r["seq"], "created", None, r["at_ms"]) for r in rows)

    def load(self) -> dict | None:
        return {k[0]: tuple(x) for k, x in self.live.iterator()}

    def save(self, before: dict, kept: dict) -> None:
        for task in before.keys() - kept.keys():
            self.live.removeKey((task,))
        for task in kept.keys() - before.keys():
            self.live.updateValue((task,), kept[task])

    def apply(self, key: str, kept: dict, row: tuple, out: list[Row]) -> dict:
        at, seq, event, task, digest = row
        if event != "requested":
            return {k: x for k, x in kept.items() if k != task}
        found = min(kept, key=lambda k: (kept[k][0], k), default=None)
        outcome = "created" if found is None else "replayed" if kept[found][1] == digest else "conflict"
        out.append(ANSWER(seq, outcome, found, at))
        return {task: (at, digest)} if found is None and key[:1] == "k" else kept


def _timed(rows: DataFrame, late: str, use: Column) -> DataFrame:
    """Rows with their watermark, and RocksDB for what is kept of them. Rows that aren't of use, clocks among them, go after they
    have moved the watermark on: the filter is one term that asks for the time too, so that it isn't pushed below."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    numbers = [F.col(c).cast("long").alias(c) for c in ("at_ms", "seq")]
    rows = rows.select(*[c for c in rows.columns if c not in ("at_ms", "seq")], *numbers).withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return rows.filter(F.when(use & (F.col("event") != CLOCK), F.col("at")).isNotNull())


def task_life(events: DataFrame, late: str = "1 minute", p: Tasks = Tasks()) -> DataFrame:
    """Every change of a task's status, from a stream of (task_id, event, at_ms, seq): queued, running, cancelled, succeeded,
    failed; expired p.retention_ms after the end, with its id and times only, and deleted p.expired_metadata_ms later.

    A task begins with `created`; events before it, after an end, or of other names change nothing. version counts a
    task's changes. Rows without a task_id, time or event are ignored.
    """
    rows = _timed(events.select("task_id", "event", "at_ms", "seq"), late, F.col("task_id").isNotNull())
    return rows.groupBy("task_id").transformWithState(Life(p), LIFE, "update", "EventTime")


def life_at(events: DataFrame, now_ms: int, p: Tasks = Tasks()) -> DataFrame:
    """The same from a table, as tasks stand at a time: the last change of each, deleted ones included."""
    order = F.struct("at_ms", "seq")
    rows = events.filter(F.col("task_id").isNotNull() & (F.col("at_ms") <= now_ms) & F.col("event").isin(*EVENTS)).select("task_id", "event", F.col("at_ms").cast("long").alias("at_ms"), F.col("seq").cast("long").alias("seq"))
    begun = rows.groupBy("task_id").agg(F.min(F.when(F.col("event") == "created", order)).alias("born")).filter("born is not null")
    after = rows.join(begun, "task_id").filter(order >= F.col("born"))
    first = lambda *names: F.min(F.when(F.col("event").isin(*names), order))
    ends = F.min(F.when(F.col("event").isin("succeeded", "failed"), F.struct("at_ms", "seq", "event")))
    t = after.groupBy("task_id", "born").agg(first("started").alias("s"), first("cancel_requested").alias("c"), ends.alias("e"))
    before = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.struct(f"{a}.at_ms", f"{a}.seq") < F.struct(f"{b}.at_ms", f"{b}.seq")))
    dropped = before("c", "s") & before("c", "e")
    status = F.when(dropped, "cancelled").when(F.col("e").isNotNull(), F.when(before("c", "e"), "cancelled").otherwise(F.col("e.event"))).when(F.col("s").isNotNull(), "running").otherwise("queued")
    t = t.select("task_id", F.col("born.at_ms").alias("created_at_ms"), status.alias("status"), F.when(dropped, F.col("c.at_ms")).otherwise(F.col("e.at_ms")).alias("finished_at_ms"), F.col("s.at_ms").alias("s"))
    gone = F.col("finished_at_ms") + p.retention_ms
    t = t.withColumn("expired_at_ms", F.when(gone <= now_ms, gone))
    old = F.col("expired_at_ms").isNotNull()
    status = F.when(F.col("expired_at_ms") + p.expired_metadata_ms <= now_ms, "deleted").when(old, "expired").otherwise(F.col("status"))
    return t.select("task_id", status.alias("status"), "created_at_ms", F.when(~old, F.col("finished_at_ms")).alias("finished_at_ms"), "expired_at_ms")


def idempotent_creation(rows: DataFrame, late: str = "1 minute", tasks: DataFrame | None = None) -> DataFrame:
    """Answers every request of a stream of (idempotency_key, event, at_ms, seq, task_id, input_digest).

    event `requested`: seq is the request's id, task_id the one that it would create. While the key has a live task, the
    first of them answers: replayed if its input is the same, conflict if not; otherwise the request creates its task.
    event `expired`: that task of the key is no longer live. tasks: those live before the stream begins, if any
    (task_id, idempotency_key, input_digest, status, created_at_ms). A request without a key always creates, at once, and
    nothing is kept of it: such requests share KEYLESS groups, as each group costs calls of its own. Rows without a time are ignored, as are expiries without a key.
    """
    key = F.when(F.col("idempotency_key").isNotNull(), F.concat(F.lit("k"), "idempotency_key")).when((F.col("event") == "requested") & F.col("seq").isNotNull(), F.concat(F.lit("r"), F.pmod(F.xxhash64("seq"), F.lit(KEYLESS)).cast("string")))
    rows = rows.select(key.alias("owner"), "event", "at_ms", "seq", "task_id", "input_digest")
    rows = _timed(rows, late, F.col("event").isin("requested", "expired") & F.col("owner").isNotNull())
    known = None
    if tasks is not None:
        live = tasks.filter("idempotency_key is not null and status <> 'expired'")
        known = live.select(F.concat(F.lit("k"), "idempotency_key").alias("owner"), "task_id", F.col("created_at_ms").cast("long").alias("created_at_ms"), "input_digest").groupBy("owner")
    return rows.groupBy("owner").transformWithState(FirstWriter(), ANSWERS, "update", "EventTime", known)
