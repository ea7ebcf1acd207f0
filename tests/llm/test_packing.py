from array import array
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from texts import clashing, frame, rows
from tokenizers import Tokenizer
from voxframe.llm import packing

WHOLE = Tokenizer.from_file(packing.TOKENIZER)


def brute(sizes, lengths):
    """The same rule by looking at every open bin and every piece that is left."""
    lengths, bins, placed = sorted(set(lengths)), [], [None] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))

    def price(c, size, left):
        used = size
        for x in left:  # largest first
            if used + x <= c:
                used += x
        return packing.cost(min(k for k in lengths if k >= used)) / used

    for at, i in enumerate(order):
        fits = [b for b in bins if b["room"] >= sizes[i]]
        if fits:
            least = min(b["room"] for b in fits)
            b = max((b for b in fits if b["room"] == least), key=lambda b: b["touched"])
        else:
            left = [sizes[k] for k in order[at + 1 :]]
            c = min((c for c in lengths if c >= sizes[i]), key=lambda c: (price(c, sizes[i], left), c))
            b = {"n": len(bins), "room": c, "used": 0, "touched": 0}
            bins.append(b)
        placed[i] = (b["n"], b["used"])
        b["room"] -= sizes[i]
        b["used"] += sizes[i]
        b["touched"] = max(x["touched"] for x in bins) + 1
    return [(k, at, min(c for c in lengths if c >= bins[k]["used"])) for k, at in placed]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.sampled_from([(64,), (8, 16, 64), (10, 33, 64)]))
def test_best_fit_by_brute_force(sizes, lengths):
    assert packing.pack(sizes, lengths) == brute(sizes, lengths)


def test_the_capacity_follows_what_remains():
    """A piece of 300 opens another bin where pieces of 210 remain than where pieces of 240 do."""
    of = lambda *rest: packing.opened(300, packing.Remaining(list(rest)), packing.LENGTHS)
    assert (of(*[210] * 50), of(*[241, 240, 240]), of()) == (512, 1024, 512)
    assert of(*[230] * 9) == 1024


def check(out, data, lengths):
    docs, bins = defaultdict(list), defaultdict(list)
    for r in out:
        bins[r.sequence_id].append(r)
        if r.doc_id is not None:
            docs[r.doc_id].append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        used = sum(r.n_tokens for r in b)
        assert {r.capacity for r in b} == {min(c for c in lengths if c >= used)}
        assert [r.offset for r in b] == [sum(x.n_tokens for x in b[:k]) for k in range(len(b))]
    texts = defaultdict(list)
    for doc_id, text in data:
        texts[doc_id].append(text or "")
    for doc_id, held in docs.items():
        want = texts[doc_id]
        ids = [[*WHOLE.encode(t, add_special_tokens=False).ids, packing.END] for t in want]
        assert sum(r.n_tokens for r in held) == sum(map(len, ids))
        assert all(len(r.ids) == 4 * r.n_tokens for r in held)
        if len(want) == 1:
            held.sort(key=lambda r: r.piece)
            assert array("I", b"".join(bytes(r.ids) for r in held)).tolist() == ids[0]
            assert all(r.n_tokens == max(lengths) for r in held[:-1])
    assert set(docs) == set(texts) - {None}


def test_hard_cases(spark):
    for lengths in (packing.LENGTHS, (8, 32)):
        check(packing.packed(clashing(spark), lengths).collect(), [(r[0], r[1]) for r in rows()], lengths)
    assert packing.packed(frame(spark, [])).collect() == []


def test_exact_multiples(spark):
    data = [(i, " ".join(["w"] * i), None, None, 0) for i in range(26)]
    check(packing.packed(frame(spark, data), (8,)).collect(), [(d[0], d[1]) for d in data], (8,))


def test_documents_fill_their_sequences(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = packing.packed(df)
    check(out.collect(), [(r.doc_id, r.text) for r in df.collect()], packing.LENGTHS)
    s = packing.sequences(out).selectExpr("sum(n_tokens) as used", "sum(capacity) as room").first()
    assert s.used / s.room > 0.98


def test_small_partitions_fill_their_sequences(spark):
    data = [(i, " ".join(["word"] * 20), None, None, 0) for i in range(64)]
    for with_ids in (True, False):
        out = packing.packed(frame(spark, data).repartition(64, "doc_id"), with_ids=with_ids)
        rows = out.collect()
        n = sum(r.n_tokens for r in rows) / 64
        room = {r.sequence_id: r.capacity for r in rows}
        assert len(rows) == 64
        assert 64 * n / sum(room.values()) > 0.8
        if with_ids:
            check(rows, [(d[0], d[1]) for d in data], packing.LENGTHS)
