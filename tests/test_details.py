"""Configuration files, uploads, failures of models, datasets that are replaced, quantiles by blocks."""

import json

import pytest
from pyspark.sql import functions as F
from voxframe import params
from voxframe.functions import text as tx
from voxframe.operators import clusters, models
from voxframe.operators.timelines import Blocks
from voxframe.sources import exports

BASE = {"schema_version": 1, "algorithm": {"a": 1}, "components": {"one": {"base_url": "http://x/"}, "two": {"base_url": "http://y//"}}, "runtime": {"memory_target_ratio": 0.5, "memory_hard_limit_ratio": 0.8, "temporary_root": "tmp/work"}, "input": {"n": 1, "m": 2}}


def test_configuration_files(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps(BASE))
    (tmp_path / "over.json").write_text(json.dumps({"input": {"n": 5}}))
    got = params.read_config(str(tmp_path / "base.json"), str(tmp_path / "over.json"), {"two": "http://z:1/"})
    assert got["input"] == {"n": 5, "m": 2} and [c["base_url"] for c in got["components"].values()] == ["http://x", "http://z:1"]
    assert got["runtime"]["temporary_root"] == str(tmp_path / "tmp/work") and BASE["input"]["n"] == 1
    for name, text in (("none", None), ("bad", "{: ["), ("list", "[1]"), ("ratio", json.dumps({**BASE, "runtime": {"memory_target_ratio": 0.9, "memory_hard_limit_ratio": 0.8}})), ("version", json.dumps({**BASE, "schema_version": 2}))):
        if text is not None:
            (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match="CONFIG_INVALID"):
            params.read_config(str(tmp_path / name))
    (tmp_path / "locked.json").write_text(json.dumps({"algorithm": {"a": 2}}))
    with pytest.raises(ValueError, match="CONFIG_LOCKED_OVERRIDE: algorithm"):
        params.read_config(str(tmp_path / "base.json"), str(tmp_path / "locked.json"))


def test_configuration_in_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "base.yaml").write_text("schema_version: 1\nalgorithm: {a: 1}\ninput:\n  n: 1\n")
    assert params.read_config(str(tmp_path / "base.yaml"))["input"] == {"n": 1}


def test_uploads_have_a_limit(spark):
    df = spark.createDataFrame([(b"abc",), (b"abcd",), (None,)], "b binary")
    got = [tuple(r) for r in df.select(*[c.alias(str(k)) for k, c in enumerate(tx.upload(F.col("b"), "audio", 3))]).collect()]
    assert got[0][0][:8] == "ba7816bf" and [r[1:] for r in got] == [(3, None), (4, "AUDIO_TOO_LARGE"), (None, None)] and got[1][0] is None


def test_failures_of_chunks_are_told_and_others_end_the_job(spark):
    def model():
        def call(x):
            if x[0] == 1:
                raise KeyError("x")
            return [[1.0, 0.0]] if x[0] == 2 else "no numbers"

        return call

    rows = [(1, 0, 100, 0, 100, [1.0]), (1, 100, 200, 100, 200, [2.0]), (2, 0, 100, 0, 100, [3.0])]
    df = spark.createDataFrame(rows, "recording_id long, read_start long, read_end long, core_start long, core_end long, samples array<double>")
    scores = models.scored(df, model)
    assert sorted(map(tuple, models.failures(scores).collect())) == [(1, 0, 100, "KeyError"), (2, 0, 100, "ValueError")]
    assert [(r.recording_id, r.start_ms, r.active) for r in models.activity(scores).collect()] == [(1, 100, 0)]

    def broken():
        raise OSError("no weights")

    with pytest.raises(Exception, match="no weights"):
        models.scored(df, broken)


def test_a_dataset_is_replaced_only_when_the_new_one_is_whole(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    made = spark.createDataFrame([("a", "s", "{}", "{}")], "sample_id string, source_id string, input string, reference string")
    tags = spark.createDataFrame([("a", ["noise"])], "sample_id string, scenarios array<string>")
    clips = spark.createDataFrame([("a", b"one")], "sample_id string, content binary")
    assert exports.write_dataset(made, tags, clips, "gold", root).count() == 3
    bad = clips.select("sample_id", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("content")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        exports.write_dataset(made, tags, bad, "gold", root, force=True)
    assert (tmp_path / "set/samples/a/audio.wav").read_bytes() == b"one"
    two = clips.select("sample_id", F.lit(b"two").alias("content"))
    assert exports.write_dataset(made, tags, two, "gold", root, force=True).count() == 3
    assert (tmp_path / "set/samples/a/audio.wav").read_bytes() == b"two" and not list(tmp_path.glob("set.*.old"))


def test_quantiles_by_blocks(spark):
    rows = [(r, k % 3, k, (k * 37 % 101) / 7, 0.25 * (1 + k % 4)) for r in range(2) for k in range(150)]
    df = spark.createDataFrame(rows, "recording_id long, label int, vec_id long, d double, weight double")
    qs = (0.1, 0.5, 0.7, 0.9, 1.0)
    a, b = (sorted(map(tuple, clusters.lower_quantiles(df, "d", qs, **by).collect())) for by in ({}, {"by": Blocks(11)}))
    assert a == b and len(a) == 6
