import hashlib
import zipfile
import zlib

import pytest
from texts import clashing, frame, rows
from voxframe.llm import media
from voxframe.llm.shared import scratch


def test_hard_cases(spark):
    out = media.features(clashing(spark)).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out)
    want = []
    for doc_id, text, *_ in rows():
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want.append((str(doc_id), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert got == sorted(want)
    by_payload = {}
    for r in out:
        by_payload.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_payload.values())


def test_empty(spark):
    assert media.features(frame(spark, [])).collect() == []


def test_png_round_trip():
    for payload in (bytes(64), bytes(range(256)) * 3, b"ab" * 32 * 1000):
        assert media.from_png(media.to_png(payload)) == payload


def test_ranges_cover_every_member_once(spark):
    path = scratch(spark, "archive")
    media.store(frame(spark), path)
    members = spark.read.format("media_archive").option("rangeBytes", 500).load(path)
    assert members.rdd.getNumPartitions() > 3
    assert members.select("archive", "offset").distinct().count() == members.count() == len(rows())


def test_a_member_is_retried_at_its_offset(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(4):
            z.writestr(f"{k}_1.png", media.to_png(bytes([k]) * 64))
    calls, plain = [], media.Source.member

    def flaky(self, start, end, size, crc, method, again):
        calls.append(start)
        if calls.count(start) == 1:
            raise OSError("lost")
        return plain(self, start, end, size, crc, method, again)

    monkeypatch.setattr(media.Source, "member", flaky)
    reader = media.ArchiveReader({"path": f"file://{tmp_path}"})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["attempts"] for r in got] == [2] * 4 and len(set(calls)) == 4


def test_a_damaged_member_spoils_no_other(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(4):
            z.writestr(str(k), bytes([65 + k]) * 100)
    raw = bytearray(path.read_bytes())
    raw[raw.index(b"B" * 100) + 5] = 0
    path.write_bytes(raw)
    with pytest.raises(OSError):
        reader = media.ArchiveReader({"path": f"file://{tmp_path}"})
        list(reader.read(reader.partitions()[0]))
    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "onerror": "record"})
    got = [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
    assert [r["content"] is None for r in got] == [False, True, False, False] and got[1]["attempts"] == 3


def plain_feature(payload):
    rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    steps = sum(abs(a - b) for r in rows for a, b in zip(r, r[1:]))
    return f"{len(rows)};{sum(payload)};{sum(b * b for b in payload)};{steps};" + ",".join(str(sum(b // 32 == k for b in payload)) for k in range(8))


def test_documents_by_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in media.features(df).collect()}
    for r in df.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert got[r.doc_id] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), plain_feature(payload))


def test_a_directory_is_listed_again(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0", b"A" * 100)
    calls, plain = [], media.Source.open

    def flaky(self, again=False):
        calls.append(again)
        if len(calls) == 1:
            raise OSError("lost")
        return plain(self, again)

    monkeypatch.setattr(media.Source, "open", flaky)
    reader = media.ArchiveReader({"path": f"file://{tmp_path}"})
    assert [r["content"] for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()] == [b"A" * 100] and calls[1]


def test_a_damaged_directory(tmp_path):
    (tmp_path / "a.zip").write_bytes(b"PK no archive at all" * 10)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("0", b"B" * 50)
    with pytest.raises(OSError, match="no readable directory"):
        reader = media.ArchiveReader({"path": f"file://{tmp_path}"})
        [list(reader.read(p)) for p in reader.partitions()]
    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "onerror": "record", "rangebytes": "60"})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["content"] or b"", bool(r["error"])) for r in got) == [(b"", True), (b"B" * 50, False)]


def test_deflated_members_are_read(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("0", b"deflated " * 100)
    reader = media.ArchiveReader({"path": f"file://{tmp_path}"})
    assert [r["content"] for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()] == [b"deflated " * 100]


def test_writes_to_one_path_do_not_meet(spark, tmp_path):
    """A write that is given up leaves another's pending archives alone."""
    import pyarrow as pa

    one, two = (media.ArchiveWriter({"path": f"file://{tmp_path}"}) for _ in range(2))
    rows_ = pa.RecordBatch.from_arrays([pa.array(["0"]), pa.array([b"x" * 10], pa.binary())], ["name", "content"])
    a, b = one.write(iter([rows_])), two.write(iter([rows_]))
    two.abort([b])
    one.commit([a])
    assert [p.suffix for p in tmp_path.iterdir()] == [".zip"]
