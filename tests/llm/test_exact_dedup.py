import hashlib
import re

from pyspark.sql import functions as F
from texts import clashing, frame, rows
from voxframe.llm import exact_dedup
from voxframe.llm.shared import publish, scratch


def brute(data):
    groups = {}
    for doc_id, text in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return {norm: (min(g)[3], len(g)) for norm, g in groups.items()}


def expected(data):
    best = brute(data)
    return sorted(((d, *best[n], hashlib.sha256(n.encode()).hexdigest()) for d, t in data for n in [re.sub(r"[\x20\x09-\x0D]", "", t or "")]), key=str)


def test_hard_cases(spark):
    data = [(r[0], r[1]) for r in rows()]
    out = exact_dedup.report(clashing(spark)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == expected(data)
    assert sum(r.kept for r in out) == len(brute(data))
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_collisions_are_told_apart(spark):
    """With a digest of two values nearly all hits are of different texts."""
    data = [(r[0], r[1]) for r in rows()]
    weak = lambda norm: (F.crc32(norm) % 2).cast("string").cast("binary")
    out = exact_dedup.report(frame(spark), digest=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == expected(data)
    assert sum(r.kept for r in out) == len(brute(data))


def test_empty(spark):
    assert exact_dedup.report(frame(spark, [])).collect() == []


def test_survivors(spark, tmp_path):
    for df in (clashing(spark), publish(clashing(spark), f"file://{tmp_path}/docs")):
        kept = exact_dedup.survivors(df)
        assert kept.columns == df.columns
        assert kept.count() == len(brute([(r[0], r[1]) for r in rows()]))


def test_rows_of_one_file_row(spark, tmp_path):
    """Exploded rows share a file's row; each is a row of its own all the same."""
    twice = publish(frame(spark), f"file://{tmp_path}/docs").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(2))))
    data = [(r[0], r[1]) for r in rows()] * 2
    out = exact_dedup.report(twice).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == expected(data)
    assert sum(r.kept for r in out) == len(brute(data)) == exact_dedup.survivors(twice).count()


def test_later_documents_continue_from_the_state(spark):
    state, df = scratch(spark, "kept"), frame(spark)
    data = [(r[0], r[1]) for r in rows()]
    early = [d for d in data if d[0] is not None and d[0] % 2]
    for part, known in ((df.filter("doc_id % 2 = 1"), early), (df.filter("doc_id % 2 = 0 or doc_id is null"), data)):
        out = exact_dedup.report(part, state=state).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == expected(known)
        assert sum(r.kept for r in out) == len(brute(known))


def test_state_outlives_a_run(spark):
    """A second run of the stream sees what the first retained."""
    feed, state = scratch(spark, "feed"), scratch(spark, "state")
    source = exact_dedup.located(publish(frame(spark).select("doc_id", "text"), scratch(spark, "content")))
    text = F.coalesce("row.text", F.lit(""))
    rows_ = source.select(exact_dedup.sha256(exact_dedup.normalised(text)).alias("digest"), F.length(text).alias("n_points"), F.col("row.doc_id").alias("doc_id"), *exact_dedup.LOCATOR)
    part = publish(rows_, scratch(spark, "all"))
    part.filter("doc_id <= 1").write.parquet(feed)
    assert {r.n_rows for r in exact_dedup.retained(spark, feed, state).collect()} == {1, 2}
    part.filter("doc_id > 1 or doc_id is null").write.mode("append").parquet(feed)
    both = {bytes(r.digest): r.n_rows for r in exact_dedup.retained(spark, feed, state).collect()}
    assert sum(both.values()) == len(rows())


def test_documents_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.report(df).collect()), key=str) == expected(data)
