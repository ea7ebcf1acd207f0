"""Task facts as streaming source and sink: failures and restarts neither lose nor repeat a fact."""

import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F
from voxframe.sources import documents, task_store

ID = "{:032x}".format
KIND = "task_id string, status string, created_at_ms long, updated_at_ms long"


def put(root, k, **fields):
    folder = root / ID(k)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "task.json").write_text(json.dumps({"task_id": ID(k), "status": "queued", **fields}, indent=2))


def seen(spark, root, out, settle=0):
    """Facts that a stream from root gives since the last call, by batch."""

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/n={number}")

    before = set(map(tuple, spark.read.parquet(f"{out}/rows").select("task_id", "status", "updated_at_ms", "batch").collect())) if os.path.isdir(f"{out}/rows") else set()
    stream = task_store.changed_facts(spark, f"file://{root}", settle)
    stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    if not os.path.isdir(f"{out}/rows"):
        return []
    return sorted((int(r[0], 16), *r[1:3]) for r in set(map(tuple, spark.read.parquet(f"{out}/rows").select("task_id", "status", "updated_at_ms", "batch").collect())) - before)


def test_source(spark, tmp_path):
    root = tmp_path / "tasks"
    root.mkdir()
    assert seen(spark, root, tmp_path / "o") == []
    for k in range(5):
        put(root, k, updated_at_ms=k)
    (root / ID(9)).mkdir()
    (root / ID(10)).mkdir()
    (root / ID(10) / "task.json").write_text('{"task_id": ')
    (root / ID(11)).mkdir()
    (root / ID(11) / "task.json").write_text(json.dumps({"task_id": ID(12)}))
    (root / ID(13)).mkdir()
    (root / ID(13) / "task.json").write_text(json.dumps({"task_id": ID(13), "status": 5}))
    (root / "notes").mkdir()
    (root / "notes" / "task.json").write_text(json.dumps({"task_id": "notes"}))
    (root / ID(14)).mkdir()
    (root / ID(14) / "task.json").write_text("[1]")
    assert seen(spark, root, tmp_path / "o") == [(k, "queued", k) for k in range(5)]
    assert sorted(int(r.task_id, 16) for r in task_store.task_facts(spark, f"file://{root}").collect()) == [0, 1, 2, 3, 4]
    assert seen(spark, root, tmp_path / "o") == []
    put(root, 3, updated_at_ms=30)
    put(root, 5)
    shutil.rmtree(root / ID(4))
    assert seen(spark, root, tmp_path / "o") == [(3, "queued", 30), (5, "queued", None)]
    put(root, 6)
    put(root, 7)
    shutil.rmtree(root / ID(7))
    assert seen(spark, root, tmp_path / "o") == [(6, "queued", None)]
    shutil.rmtree(root / ID(6))  # the newest is gone, and no older one comes again
    assert seen(spark, root, tmp_path / "o") == []
    assert task_store.task_facts(spark, f"file://{tmp_path}/none").collect() == []


def test_files_rest_before_they_count_and_offsets_never_go_back(tmp_path):
    put(tmp_path, 1)
    reader = task_store.TaskStreamReader({"path": f"file://{tmp_path}", "settlems": "200"})
    first = reader.latestOffset()
    assert reader.partitions(reader.initialOffset(), first) == [] == reader.partitions(first, reader.latestOffset())
    time.sleep(0.25)
    second = reader.latestOffset()
    assert [f for p in reader.partitions(first, second) for f, _ in p.files] == [ID(1)]
    shutil.rmtree(tmp_path / ID(1))
    assert reader.latestOffset() == second


def test_a_file_that_changes_while_a_batch_is_read_comes_with_the_next(tmp_path):
    root = tmp_path / "tasks"
    put(root, 1, updated_at_ms=1)
    put(root, 2, updated_at_ms=1)
    reader = task_store.TaskStreamReader({"path": f"file://{root}", "settlems": "0"})
    end = reader.latestOffset()
    (part,) = reader.partitions(reader.initialOffset(), end)
    time.sleep(0.02)
    put(root, 2, updated_at_ms=2)
    assert [(r[0], r[4]) for r in reader.read(part)] == [(ID(1), 1)]
    later = reader.latestOffset()
    assert [(r[0], r[4]) for p in reader.partitions(end, later) for r in reader.read(p)] == [(ID(2), 2)]
    assert reader.partitions(later, later) == []


def test_sink_that_fails_between_write_and_commit(spark, tmp_path):
    root, mirror = tmp_path / "tasks", tmp_path / "mirror"
    rows = [[(ID(k), "queued", k, 10) for k in range(6)], [(ID(k), "running", k, 20) for k in range(4)] + [(ID(1), "succeeded", 1, 30), (ID(5), "deleted", 5, 25), (ID(5), "running", 5, 24)]]

    def run():
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        task_store.kept_facts(stream, f"file://{root}", f"{tmp_path}/checkpoint").awaitTermination()

    spark.createDataFrame(rows[0], KIND).coalesce(1).write.parquet(f"{tmp_path}/in")
    root.mkdir()
    (root / "_commits").write_text("in the way")
    with pytest.raises(Exception, match="_commits"):
        run()
    at = {p: p.stat().st_mtime_ns for p in root.glob("*/task.json")}
    assert len(at) == 6
    assert len(seen(spark, root, mirror)) == 6
    (root / "_commits").unlink()
    run()
    assert {p: p.stat().st_mtime_ns for p in root.glob("*/task.json")} == at  # run again, it changes nothing
    assert seen(spark, root, mirror) == []
    assert json.loads((root / "_commits/0.json").read_text()) == {"batch": 0, "written": 0, "kept": 6}
    for name in ("input", "result"):
        (root / ID(2) / name).mkdir()
    spark.createDataFrame(rows[1], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert seen(spark, root, mirror) == [(0, "running", 20), (1, "succeeded", 30), (2, "running", 20), (3, "running", 20)]
    assert not (root / ID(5)).exists() and (root / ID(2) / "input").exists()
    spark.createDataFrame([(ID(2), "expired", 2, 40), (ID(3), "queued", 3, 5)], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert not (root / ID(2) / "input").exists() and not (root / ID(2) / "result").exists()
    assert json.loads((root / ID(2) / "task.json").read_text()) == {"task_id": ID(2), "status": "expired", "created_at_ms": 2, "updated_at_ms": 40}
    assert seen(spark, root, mirror) == [(2, "expired", 40)]
    assert sorted(p.name for p in (root / "_commits").iterdir()) == ["0.json", "1.json", "2.json"]


def test_sink_refuses_other_names(tmp_path):
    writer = task_store.TaskWriter({"path": f"file://{tmp_path}"})
    for name in ("../" + "0" * 29, "0" * 31, "A" * 32, ""):
        with pytest.raises(ValueError, match="TASK_ID_INVALID"):
            writer.put(*task_store.fs.FileSystem.from_uri(f"file://{tmp_path}"), {"task_id": name})


@pytest.mark.parametrize(("line", "number"), [("[1]", 1), ("{", 1), ('{"id": "", "reference_path": "x"}', 1), ('\n{"id": "1", "reference_path": "x"}\n\n{"reference_path": "x"}', 4)])
def test_manifest_names_the_row(spark, tmp_path, line, number):
    (tmp_path / "m.jsonl").write_text(line)
    with pytest.raises(Exception, match=f"EVALUATION_MANIFEST_INVALID: invalid manifest row {number}"):
        documents.manifest(spark, f"file://{tmp_path}/m.jsonl").collect()
