"""Tasks' lives and idempotent creation as streams, against plain loops, however the input is cut and restarted."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from voxframe.params import Tasks
from voxframe.streaming import sessions, tasks

P = Tasks(retention_ms=1000, expired_metadata_ms=2000)
EVENT = "task_id string, event string, at_ms long, seq long"
REQUEST = "idempotency_key string, event string, at_ms long, seq long, task_id string, input_digest string"


@pytest.fixture
def few(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", kept)


def drain(spark, build, kind, slices, root, restart=True):
    """The rows that a stream gives for slices of rows that arrive one after the other; with a restart after each from the
    checkpoint, or in one go."""
    path, out = f"{root}/in", []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/n={number}")

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
        build(stream).writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    for rows in slices:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
        if restart:
            run()
    if not restart:
        run()
    out = spark.read.parquet(f"{root}/out/n=*").collect()
    return [tuple(r) for r in out]


def life(events, now):
    """Every change of a task, by a loop over its events and clean-ups at every due time."""
    out = []
    for task in sorted({e[0] for e in events}):
        s, version = None, 0

        def change(at, status, **more):
            nonlocal s, version
            version += 1
            s = {**(s or {"created": at, "finished": None, "expired": None, "cancel": False}), "status": status, **more}
            out.append((task, status, at, s["created"], s["finished"], s["expired"], version))

        def clean(until):
            nonlocal s
            while s:
                if s["status"] == "expired" and s["expired"] + P.expired_metadata_ms <= until:
                    change(s["expired"] + P.expired_metadata_ms, "deleted")
                    s = None
                elif s and s["status"] in P.terminal and s["finished"] + P.retention_ms <= until:
                    at = s["finished"] + P.retention_ms
                    change(at, "expired", finished=None, expired=at)
                else:
                    break

        for _, event, at, _ in sorted((e for e in events if e[0] == task and e[2] <= now), key=lambda e: (e[2], e[3])):
            clean(at - 1)
            if s is None:
                if event == "created" and version == 0:
                    change(at, "queued")
            elif s["status"] in ("queued", "running"):
                if event == "cancel_requested":
                    s["cancel"] = True
                    if s["status"] == "queued":
                        change(at, "cancelled", finished=at)
                elif event == "started" and s["status"] != "running":
                    change(at, "running")
                elif event in ("succeeded", "failed"):
                    change(at, "cancelled" if s["cancel"] else event, finished=at)
        clean(now)
    return out


def events(seed, n=150):
    r = random.Random(seed)
    names = ["started", "cancel_requested", "succeeded", "failed", "progress", "created"]
    out = [(f"t{k}", "created", 100 + 20 * k, -1) for k in range(25) if k % 8]
    return out + [(f"t{r.randrange(25)}", r.choice(names), r.randrange(100, 1500), k) for k in range(n)]


@pytest.mark.parametrize("restart", [True, False])
def test_life_however_it_is_cut(few, tmp_path, restart):
    data, now = events(1), 3200
    shuffled = random.Random(2).sample(data, len(data))
    clock = [(None, tasks.CLOCK, now + 5000, None)]
    slices = [shuffled[k::3] for k in range(3)] + [[(None, "succeeded", 600, 1), ("t9", None, 700, 1), ("t9", "created", None, 1)], clock]
    got = drain(few, lambda s: tasks.task_life(s, "5 seconds", P), EVENT, slices, f"file://{tmp_path}/{uuid.uuid4().hex}", restart)
    want = life(data, now)
    assert sorted(got) == sorted(want)
    assert {"queued", "running", "cancelled", "succeeded", "failed", "expired", "deleted"} == {r[1] for r in want}
    batch = {tuple(r) for r in tasks.life_at(few.createDataFrame(data, EVENT), now, P).collect()}
    last = {r[0]: r for r in sorted(want, key=lambda r: (r[0], r[6]))}
    assert batch == {(r[0], r[1], r[3], r[4], r[5]) for r in last.values()}


def test_a_task_expires_and_is_deleted_without_an_event_of_its_own(few, tmp_path):
    slices = [[("a", "created", 10, 1), ("a", "succeeded", 20, 2)], [("b", "created", 1500, 3)], [("b", "started", 4000, 4)], [("c", "created", 9000, 5)]]
    got = drain(few, lambda s: tasks.task_life(s, "0 seconds", P), EVENT, slices, f"file://{tmp_path}")
    assert [(r[1], r[2]) for r in sorted(got, key=lambda r: (r[0], r[6])) if r[0] == "a"] == [("queued", 10), ("succeeded", 20), ("expired", 1020), ("deleted", 3020)]


def answers(requests, old):
    """Outcome by request, by a loop."""
    out, live = {}, {}
    for task, key, digest, _, at in old:
        live.setdefault(key, {})[task] = (at, digest)
    for key, event, _, seq, task, digest in sorted(requests, key=lambda r: (r[2], r[3])):
        mine = live.setdefault(key, {}) if key else {}
        if event == "expired":
            mine.pop(task, None)
        elif not mine:
            mine[task] = (_, digest)
            out[seq] = ("created", None)
        else:
            found = min(mine, key=lambda t: (mine[t][0], t))
            out[seq] = ("replayed" if mine[found][1] == digest else "conflict", found)
    return out


@pytest.mark.parametrize("restart", [True, False])
def test_creation_however_it_is_cut(few, tmp_path, restart):
    r = random.Random(5)
    old = [(f"o{k}", f"k{k % 4}", str(k % 2), "running", k + 1) for k in range(6)]
    data = [(r.choice([None, *(f"k{k}" for k in range(9))]), "requested", 1000 + 10 * k, k, f"n{k}", str(r.randrange(2))) for k in range(80)]
    data += [(f"k{k % 4}", "expired", 1000 + 130 * k + 5, 1000 + k, f"o{k}", None) for k in range(5)]
    data += [(x[0], "expired", x[2] + 205, 2000 + x[3], x[4], None) for x in data[:60:5] if x[0]]
    shuffled = r.sample(data, len(data))
    slices = [shuffled[:30], shuffled[30:], [(None, "expired", 1500, 1, "o1", None), ("k1", "requested", None, 77, "x", "1")], [(None, tasks.CLOCK, 90_000, None, None, None)]]
    known = few.createDataFrame([*old, ("gone", "k8", "1", "expired", 0), ("free", None, "1", "running", 0)], "task_id string, idempotency_key string, input_digest string, status string, created_at_ms long")
    got = drain(few, lambda s: tasks.idempotent_creation(s, "20 seconds", known), REQUEST, slices, f"file://{tmp_path}/{uuid.uuid4().hex}", restart)
    want = answers(data, old)
    assert {(r[0], r[1], r[2]) for r in got} == {(k, *x) for k, x in want.items()} and len(got) == len(want)
    # Keys that have a task throughout get the answers of the batch form.
    batch = sessions.idempotent(few.createDataFrame(data, REQUEST).filter("event = 'requested' and idempotency_key = 'k1'").drop("task_id"), known).collect()
    assert all(want[b["seq"]] == (b["outcome"], b["found_task"]) for b in batch if b["at_ms"] < 1130)


def test_requests_without_a_key_wait_for_nothing(few, tmp_path):
    data = [(None, "requested", 1000 + k, k, f"n{k}", "1") for k in range(40)] + [("k", "requested", 1000, 100, "n", "1"), (None, "requested", 1000, None, "x", "1")]
    got = drain(few, lambda s: tasks.idempotent_creation(s, "20 seconds"), REQUEST, [data], f"file://{tmp_path}")
    assert sorted((r[0], r[1], r[2]) for r in got) == [(k, "created", None) for k in range(40)]


def test_times_that_are_absent(spark):
    now, day = 10 * 86_400_000, 86_400_000
    data = [("a", "succeeded", None, None, None), ("b", "succeeded", 0, None, now - day), ("c", "failed", now - day, None, None), ("d", "expired", None, None, 1), ("e", "expired", 1, 0, 1), ("f", "expired", None, now - 2 * day, None), ("g", "cancelled", now - day + 1, None, 1), ("h", "running", 1, None, 1)]
    df = spark.createDataFrame(data, "task_id string, status string, finished_at_ms long, expired_at_ms long, updated_at_ms long")
    p = Tasks(retention_ms=day, expired_metadata_ms=2 * day)
    got = {r.task_id: r.action for r in sessions.ttl_actions(df, now, p).collect()}
    assert got == {"a": "keep", "b": "expire", "c": "expire", "d": "keep", "e": "keep", "f": "delete", "g": "keep", "h": "keep"}
    assert sessions.ttl_actions(df.drop("updated_at_ms"), now, p).filter("action = 'expire'").count() == 1
    assert sessions.ttl_actions(df, now, Tasks(day, 2 * day + 1)).filter(F.col("action") == "delete").count() == 0
