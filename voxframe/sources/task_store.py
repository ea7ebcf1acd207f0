"""A folder of task facts, <task_id>/task.json, as a table, a streaming source and a sink.

Source: an offset is a time of change. A micro-batch has the facts whose files changed after its start and up to its end;
a file that has changed again by the time it is read is left for a later batch, so no state of a task comes twice and
none that stays is lost. Files count as changed once they have rested for settleMs (if that grows between
restarts, or the clock goes back, facts of the stretch between come again). A table has all facts as they are when
read. Each task reads FILES facts. What is damaged, or has another task_id than its folder or one that isn't 32
hexadecimal digits, is passed over.

Sink: rows (task_id, status, updated_at_ms and more) become facts, null fields left out, each replaced in one move by the
task that has the row. A fact that is as new or newer already stays untouched, so a micro-batch that is run again after
a failure changes nothing that it had written. A task's rows come in order from one micro-batch to the next, in any order
within one. `expired` also removes the task's files, `deleted` the task. The commit
leaves one small file per micro-batch below _commits, written once.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from voxframe.shared import spread

FILES = 1000
#: Rows of a sink's task that are looked through at once for those that a newer one outdoes.
HELD = 50_000
LEGAL = re.compile(r"[0-9a-f]{32}")
FACT = "task_id string, status string, stage string, created_at_ms bigint, updated_at_ms bigint, finished_at_ms bigint, expired_at_ms bigint, cancel_requested_at_ms bigint, idempotency_key string, input_digest string, input_mode string"
KINDS = [(n, str if t == "string" else int) for n, t in (c.split() for c in FACT.split(", "))]


@dataclass
class Changed(InputPartition):
    """Files (task folder, time of change) of one task."""

    files: list


@dataclass
class Written(WriterCommitMessage):
    written: int
    kept: int


def parsed(raw: bytes) -> dict | None:
    """A JSON object, or None."""
    try:
        value = json.loads(raw)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


class Folder:
    """Facts below a folder."""

    def __init__(self, options: dict):
        self.root, self.settle = options["path"].rstrip("/"), int(options.get("settlems", 1000)) * 1_000_000

    def changes(self) -> list[tuple[str, int]]:
        """Every task's folder and its fact's time of change, in nanoseconds."""
        system, root = fs.FileSystem.from_uri(self.root)
        folders = [i.base_name for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory and LEGAL.fullmatch(i.base_name)]
        infos = system.get_file_info([f"{root}/{f}/task.json" for f in folders])
        return [(f, i.mtime_ns) for f, i in zip(folders, infos, strict=True) if i.type == fs.FileType.File]

    def facts(self, files: list[tuple[str, int]], as_planned: bool) -> Iterator[tuple]:
        """Rows of FACT; as_planned: of files that haven't changed since they were listed."""
        system, root = fs.FileSystem.from_uri(self.root)
        for folder, at in files:
            path = f"{root}/{folder}/task.json"
            try:
                with system.open_input_file(path) as f:
                    value = parsed(f.read())
            except OSError:  # deleted since
                continue
            if value is None or value.get("task_id") != folder or (as_planned and system.get_file_info(path).mtime_ns != at):
                continue
            row = tuple(value.get(n) for n, _ in KINDS)
            if all(x is None or (isinstance(x, kind) and not isinstance(x, bool)) for x, (_, kind) in zip(row, KINDS, strict=True)):
                yield row


def _dealt(files: list[tuple[str, int]]) -> list[Changed]:
    return [Changed(files[k : k + FILES]) for k in range(0, len(files), FILES)]


class TaskReader(Folder, DataSourceReader):
    def partitions(self) -> list[Changed]:
        return _dealt(self.changes()) or [Changed([])]

    def read(self, partition: Changed) -> Iterator[tuple]:
        return self.facts(partition.files, as_planned=False)


class TaskStreamReader(Folder, DataSourceStreamReader):
    #: The last offset that this reader gave. The newest fact may be deleted, but offsets never go back: after a restart the first
    #: one is the present, less settleMs.
    latest = None

    def initialOffset(self) -> dict:
        return {"until_ns": 0}

    def latestOffset(self) -> dict:
        rested = time.time_ns() - self.settle
        newest = max((at for _, at in self.changes() if at <= rested), default=0)
        self.latest = rested if self.latest is None else max(self.latest, newest)
        return {"until_ns": self.latest}

    def partitions(self, start: dict, end: dict) -> list[Changed]:
        return _dealt(sorted((f for f in self.changes() if start["until_ns"] < f[1] <= end["until_ns"]), key=lambda f: f[::-1]))

    def read(self, partition: Changed) -> Iterator[tuple]:
        return self.facts(partition.files, as_planned=True)

    def commit(self, end: dict) -> None:
        pass


def _held(facts: Iterator[dict]) -> Iterator[Iterator[tuple[dict, bool]]]:
    """Facts, HELD at a time, and whether a newer one of the same task is among these, so that nothing would stay of it. Deleted and
    expired ones count always, as they remove files."""
    while held := list(islice(facts, HELD)):
        newest = {}
        for f in held:
            newest[f.get("task_id")] = max(f.get("updated_at_ms") or 0, newest.get(f.get("task_id"), 0))
        yield ((f, f.get("status") not in ("deleted", "expired") and (f.get("updated_at_ms") or 0) < newest[f.get("task_id")]) for f in held)


class TaskWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = fs.FileSystem.from_uri(self.root)
        written, kept, gone = 0, 0, {}
        facts = ({k: x for k, x in row.asDict(recursive=True).items() if x is not None} for row in iterator)
        for fact, outdone in (f for held in _held(facts) for f in held):
            task, at = fact.get("task_id"), fact.get("updated_at_ms") or 0
            if outdone and LEGAL.fullmatch(task or ""):
                kept += 1
                continue
            if fact.get("status") == "deleted":
                gone[task] = max(at, gone.get(task, at))
            elif at <= gone.get(task, at - 1):  # older than a deletion that came before it
                kept += 1
                continue
            if self.put(system, root, fact):
                written += 1
            else:
                kept += 1
        return Written(written, kept)

    def put(self, system: fs.FileSystem, root: str, fact: dict[str, Any]) -> bool:
        """Whether the fact was new."""
        if not LEGAL.fullmatch(fact.get("task_id", "")):
            raise ValueError("TASK_ID_INVALID")
        folder = f"{root}/{fact['task_id']}"
        path = f"{folder}/task.json"
        known = None
        if system.get_file_info(path).type == fs.FileType.File:
            with system.open_input_file(path) as f:
                known = parsed(f.read())
        new, old = ((x or {}).get("updated_at_ms") or 0 for x in (fact, known))
        if known is not None and (old > new or (old == new and fact.get("status") != "deleted")):
            return False
        if fact.get("status") == "deleted":
            if known is not None:
                system.delete_dir(folder)
            return known is not None
        system.create_dir(folder, recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as out:
            out.write(json.dumps(fact, ensure_ascii=False).encode())
        system.move(part, path)
        if fact.get("status") == "expired":
            for name in ("input", "result"):
                if system.get_file_info(f"{folder}/{name}").type == fs.FileType.Directory:
                    system.delete_dir(f"{folder}/{name}")
        return True

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, root = fs.FileSystem.from_uri(self.root)
        path = f"{root}/_commits/{batchId}.json"
        if system.get_file_info(path).type == fs.FileType.File:
            return
        system.create_dir(f"{root}/_commits", recursive=True)
        with system.open_output_stream(f"{path}.part") as out:
            out.write(json.dumps({"batch": batchId, "written": sum(m.written for m in messages if m), "kept": sum(m.kept for m in messages if m)}).encode())
        system.move(f"{path}.part", path)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        """Facts that were written stay; the batch that is run again finds them."""


class TaskFacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "task_facts"

    def schema(self) -> str:
        return FACT

    def reader(self, schema) -> TaskReader:
        return TaskReader(self.options)

    def streamReader(self, schema) -> TaskStreamReader:
        return TaskStreamReader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> TaskWriter:
        return TaskWriter(self.options)


def task_facts(spark: SparkSession, root: str) -> DataFrame:
    """Every fact below root."""
    spark.dataSource.register(TaskFacts)
    return spark.read.format("task_facts").load(root)


def changed_facts(spark: SparkSession, root: str, settle_ms: int = 1000) -> DataFrame:
    """A stream of the facts below root, a row whenever one has changed."""
    spark.dataSource.register(TaskFacts)
    return spark.readStream.format("task_facts").option("settleMs", settle_ms).load(root)


def kept_facts(facts: DataFrame, root: str, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """A running query that keeps a stream of facts below root; the rows of a task are written by one Spark task."""
    facts.sparkSession.dataSource.register(TaskFacts)
    out = spread(facts, "task_id").writeStream.format("task_facts").outputMode(mode)
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(root)
