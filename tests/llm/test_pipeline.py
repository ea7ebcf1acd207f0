import weakref

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_near_dedup import brute as near
from test_exact_dedup import brute as equal
from texts import clashing, frame, rows
from tokenizers import Tokenizer
from voxframe.llm import mixing, near_dedup, packing, quality, shared, token_store
from voxframe.llm.shared import publish, scratch

SF = "/root/testdata/sf0.01"
WHOLE = Tokenizer.from_file(packing.TOKENIZER)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = publish(stage(spark, docs, SF), scratch(spark, name))
        got = out.collect()
        if name == "quality":
            kept = {r.doc_id for r in quality.scores(docs, labels).filter("predicted = 1").collect()}
        elif name == "exact_dedup":
            kept = {k for k, _ in equal([(d, r.text) for d, r in left.items()]).values()}
        elif name == "near_dedup":
            kept = {c for _, c in near([(d, r.text) for d, r in left.items()], width=5).values()}
        elif name == "mixing":
            from test_mixing import expected

            want = expected([(d, r.text, r.source) for d, r in left.items()])
            assert sum(want.values()) == len(got)
            kept = {d for d, _ in want}
        if name == "packing":
            assert sum(r.n_tokens for r in got) == sum(len(WHOLE.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
            continue
        assert out.columns == columns
        assert {r.doc_id for r in got} == kept
        assert all(left[r.doc_id].text == r.text for r in got)
        left = {d: left[d] for d in kept}
        docs = out


def test_quality_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = labels.filter("quality = 1").join(docs, "doc_id")
    kept = corpus_pipeline.keep_quality(spark, docs, SF).join(good.select("doc_id"), "doc_id")
    assert kept.count() >= 0.98 * good.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and set(out.columns) == {"doc_id", "piece", "n_tokens", "sequence_id", "capacity", "offset", "ids"}
    assert out.filter(F.col("offset") + F.col("n_tokens") > F.col("capacity")).count() == 0
    assert mixing.TEMPERATURE < 1 and max(packing.LENGTHS) == 4096


def test_width_of_near_duplicates_is_given(spark, monkeypatch):
    """The stage links by five words, op1 by two as its contract says."""
    from voxframe.llm import near_dedup, queries

    seen = []
    monkeypatch.setattr(near_dedup, "survivors", lambda docs, **given: seen.append(given))
    monkeypatch.setattr(near_dedup, "near_duplicates", lambda docs, **given: seen.append(given))
    corpus_pipeline.keep_one_of_near(spark, None, SF)
    queries.op1_near_dedup(spark, SF)
    assert seen == [{"width": 5, "percent": 80}, {"width": 2}]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_hard_cases(spark, name, stage):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names."""
    docs = clashing(spark)
    got = stage(spark, docs, SF).collect()
    texts = [(r[0], r[1]) for r in rows()]
    if name == "packing":
        assert sum(r.n_tokens for r in got) == sum(len(WHOLE.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
        return
    assert got == [] or got[0].__fields__ == docs.columns
    kept = [(r.doc_id, r.text) for r in got]
    assert set(kept) <= set(texts)
    if name == "exact_dedup":
        assert sorted(d for d, _ in kept if d is not None) == sorted(k for k, _ in equal(texts).values() if k is not None)
    if name == "near_dedup":
        want = near([t for t in texts if t[0] is not None], width=5)
        assert {d for d, _ in kept if d is not None} == {c for _, c in want.values()}
        assert sum(d is None for d, _ in kept) == sum(d is None for d, _ in texts)
    if name == "mixing":
        from test_mixing import expected

        assert len(kept) == sum(expected([(r[0], r[1], r[3]) for r in rows()]).values())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_an_empty_table(spark, name, stage):
    docs = frame(spark, [])
    out = stage(spark, docs, SF)
    assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


def test_a_worker_lets_go_of_what_earlier_stages_kept():
    encoder = token_store.encoder(packing.TOKENIZER, packing.END)
    assert encoder is token_store.encoder(packing.TOKENIZER, packing.END)
    left = weakref.ref(encoder)
    del encoder
    assert len(near_dedup.shingles("a b c d e f")) == 2
    assert left() is None
    left = weakref.ref(shared.kept("near_dedup", near_dedup.Words))
    assert left()
    list(quality.passages(pa.array(["a b c"])))
    assert left() is None
