import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import BASE, clashing, frame, rows
from voxframe.llm import fingerprints as fp


def sets(text, width=fp.WIDTH):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_estimates_are_right_at_every_similarity_and_size():
    rng = np.random.default_rng(3)
    errors = []
    for n in (1, 3, 8, 40, 300, 3000):
        for share in (0.0, 0.1, 0.5, 0.8, 0.95, 1.0):
            for _ in range(8):
                words = [f"w{x}" for x in rng.integers(0, 10**9, 2 * n + 8)]
                cut = round((1 - share) * n)
                a, b = " ".join(words[: n + 4]), " ".join(words[cut : n + 4 + cut])
                got, want = fp.likeness(fp.fingerprint(a), fp.fingerprint(b)), jaccard(a, b)
                errors.append((got - want, n))
                if share in (0.0, 1.0):
                    assert abs(got - want) < 0.08
    spread = np.array([e for e, n in errors if n >= 300])
    assert np.abs(spread).max() < 0.09 and abs(spread.mean()) < 0.006
    assert abs(np.mean([e for e, _ in errors])) < 0.02


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_low_bits_are_corrected_for_chance(bits):
    rng = np.random.default_rng(5)
    got = []
    for _ in range(30):
        words = [f"v{x}" for x in rng.integers(0, 10**9, 1200)]
        a, b = " ".join(words[:800]), " ".join(words[400:])
        x, y = (fp.fingerprint(t, bits=bits) for t in (a, b))
        assert len(x) == fp.BINS * bits // 8
        got.append(fp.likeness(x, y, bits))
    assert abs(np.mean(got) - 1 / 3) < 0.015


def test_densification_spreads_evenly_and_depends_on_filled_bins_only():
    least = np.full(fp.BINS, fp.EMPTY)
    least[[5, 77, 900]] = [1, 2, 3]
    full = fp.densified(least)
    assert full[[5, 77, 900]].tolist() == [1, 2, 3]
    assert all(250 < (full == k).sum() < 440 for k in (1, 2, 3))
    more = least.copy()
    more[10] = 4
    changed = fp.densified(more) != full
    assert (fp.densified(more)[changed] == 4).all() and 180 < changed.sum() < 340


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB \n\té", max_size=400), st.integers(8, 64))
def test_blocks_make_no_difference(text, size):
    whole = fp.minima(text.encode())
    kept, fp.BLOCK = fp.BLOCK, size
    try:
        if max(map(len, re.split(rb"[\x20\x09-\x0D]+", text.encode()))) <= size:
            assert (fp.minima(text.encode()) == whole).all()
    finally:
        fp.BLOCK = kept


def test_words_longer_than_a_block():
    long = "x" * (2 * fp.BLOCK)
    a, b = f"{long} b c d e f {long}", f"\n{long.upper()}  b c d e f\t{long} "
    assert fp.fingerprint(a) == fp.fingerprint(b) != fp.fingerprint(f"{long}y b c d e f {long}")
    assert len(list(fp.blocks(f"{long} {long}".encode()))) >= 2
    for n in (fp.BLOCK - 1, fp.BLOCK, fp.BLOCK + 1):
        assert fp.fingerprint("y" * n) == fp.fingerprint("y" * n + " ") == fp.fingerprint(" " + "y" * n)


def check(got, data):
    """Rows against the pairs that any order of rows of one doc_id allows; where ids are single, exactly."""
    texts = {}
    for k, t in data:
        texts.setdefault(k, []).append(t or "")
    ids = sorted(texts, key=lambda k: (k is not None, k or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == sorted((k is not None, k or 0, len(t or "")) for k, t in data)
    for r in got:
        following = [*texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]], *(texts[r.doc_id] if len(texts[r.doc_id]) > 1 or len(ids) == 1 else [])]
        fits = []
        for own in texts[r.doc_id]:
            for other in following:
                e = fp.edited(own, other)
                if hashlib.sha256(e.encode()).hexdigest() == r.edited_sha256 and len(own) == r.n_chars:
                    fits.append((fp.fingerprint(own).hex(), fp.fingerprint(e).hex(), fp.likeness(fp.fingerprint(own), fp.fingerprint(e)), fp.likeness(fp.fingerprint(own), fp.fingerprint(other))))
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) in fits


def test_hard_cases(spark):
    check(fp.report(clashing(spark)).collect(), [(r[0], r[1]) for r in rows()])


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_partitions_make_no_difference(spark, parts):
    data = [(k, f"{BASE} {k} " + "tail " * (k % 7), None, None, 0) for k in range(25)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fp.report(frame(spark, data)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    check(got, [(r[0], r[1]) for r in data])
    assert len(got) == 25


def test_one_doc_id_for_all_rows(spark):
    same = [(None, BASE, None, None, 0)] * 30
    got = fp.report(frame(spark, same)).collect()
    assert len(got) == 30 and {r.near_next for r in got} == {1.0}
    assert len({r.fingerprint for r in got}) == 1


def test_single_and_empty(spark):
    assert fp.report(frame(spark, [])).collect() == []
    (r,) = fp.report(frame(spark, [(7, "a b c d", None, None, 7)])).collect()
    assert (r.n_chars, r.near_next) == (7, 1.0)
    assert r.edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest()


def test_documents_against_true_similarity(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = fp.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    ids = sorted(docs)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    wrong = []
    for r in got:
        own, other = docs[r.doc_id], docs[after[r.doc_id]]
        e = fp.edited(own, other)
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        wrong += [r.near_edited - jaccard(own, e), r.near_next - jaccard(own, other)]
    assert len(got) == len(docs) and np.abs(wrong).max() < 0.25 and np.sqrt(np.mean(np.square(wrong))) < 0.03 and abs(np.mean(wrong)) < 0.005


def test_columns(spark):
    df = fp.fingerprints(clashing(spark)).filter("doc_id in (0, 2, 4, 5)")
    pairs = df.selectExpr("doc_id x", "fingerprint p", "1 one").join(df.selectExpr("doc_id y", "fingerprint q", "1 one"), "one")
    got = {(r.x, r.y): r.near for r in pairs.withColumn("near", fp.alike(pairs.p, pairs.q)).collect()}
    assert got[0, 2] == got[4, 5] == 1.0 and got[0, 4] == 0.0
